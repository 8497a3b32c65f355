"""millrace: a lakehouse analytics engine expressed as PySpark plans.

Sub-packages: ``sources`` (tables, files, catalogue), ``operators``
(relational and DML building blocks), ``functions`` (scalar and aggregate
dialect), ``plans`` (registered queries with their oracle SQL) and
``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
