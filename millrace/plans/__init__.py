"""Registered queries: name -> (PySpark callable, oracle SQL)."""

from millrace.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
