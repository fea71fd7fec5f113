"""Checked queries: each operator run over the driver tables, with its SQL where SQL can say it."""

from sitewise.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
