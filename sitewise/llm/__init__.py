"""Operators of a training-data pipeline and their checked queries."""

from sitewise.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
