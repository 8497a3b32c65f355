"""Collects the queries of every plan module."""

from __future__ import annotations

from millrace.plans import lakehouse, relational, scalars, statements, tpch

MODULES = (tpch, relational, scalars, lakehouse, statements)


def queries():
    return {name: q.run for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: q.oracle for m in MODULES for name, q in m.QUERIES.items() if q.oracle}
