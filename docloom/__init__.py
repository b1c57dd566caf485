"""Document analytics on PySpark: pipelines, expressions, queries, updates and streams over nested data."""
