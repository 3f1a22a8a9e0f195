"""Queries on the supplied tables: name -> (query, DuckDB SQL or None)."""

from guardlake.plans import corpus_queries, event_queries, flow_queries, graph_queries, guard_queries, ledger_queries, metric_queries, more_queries, payload_queries, session_queries, shape_queries

QUERIES = {
    **metric_queries.QUERIES, **session_queries.QUERIES, **corpus_queries.QUERIES, **more_queries.QUERIES, **event_queries.QUERIES,
    **guard_queries.QUERIES, **shape_queries.QUERIES, **ledger_queries.QUERIES, **graph_queries.QUERIES, **payload_queries.QUERIES, **flow_queries.QUERIES,
}
