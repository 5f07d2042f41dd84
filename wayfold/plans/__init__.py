"""Queries, each with its SQL for DuckDB."""
