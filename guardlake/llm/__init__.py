"""Training-data operators: deduplication, filtering, scoring, tokenization, archives."""
