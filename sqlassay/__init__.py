"""Judge generated SQL, query logs, text pairs and health checks as Spark jobs."""
