"""guardlake: policy-trace analytics and corpus processing as PySpark transformations."""
