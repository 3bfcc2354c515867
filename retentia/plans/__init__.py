"""Registered queries (one module per area), their DuckDB oracle SQL and the registry behind __spark_entry__."""
