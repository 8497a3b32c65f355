"""Materialisations and the rewrite that answers aggregate queries from them.

A query is declared (``Spec``): source tables joined along named keys, filters on
dimensions, dimensions and measures.  A materialisation stores the result of such
a spec as Parquet.  ``answer`` looks for one over the same join whose dimensions
cover the query's dimensions and filter columns and whose measures can be
re-aggregated (SUM, COUNT, MIN, MAX; AVG as SUM over COUNT), takes the one with
the fewest rows, and otherwise runs the query on the base tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """Tables joined in order: ``joins`` holds (table, left column, right column)."""

    base: str
    joins: tuple[tuple[str, str, str], ...] = ()
    dimensions: tuple[str, ...] = ()
    measures: tuple[tuple[str, str], ...] = ()  # (function, column); count of rows: ("count", "*")
    filters: tuple[str, ...] = ()  # SQL over dimensions
    filter_columns: tuple[str, ...] = ()

    def joined(self) -> tuple:
        return (self.base, tuple(sorted(self.joins)))


def name(function: str, column: str) -> str:
    return f"{function}_{'rows' if column == '*' else column}"


def _aggregate(function: str, column: str) -> Column:
    target = F.lit(1) if column == "*" else F.col(column)
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}[function](target).alias(name(function, column))


@dataclass
class Materialization:
    spec: Spec
    path: str
    rows: int


@dataclass
class Registry:
    spark: SparkSession
    tables: Callable[[str], DataFrame]
    known: list[Materialization] = field(default_factory=list)

    def _source(self, spec: Spec) -> DataFrame:
        df = self.tables(spec.base)
        for table, left, right in spec.joins:
            df = df.join(self.tables(table), F.col(left) == F.col(right))
        for f in spec.filters:
            df = df.where(f)
        return df

    def direct(self, spec: Spec) -> DataFrame:
        return self._source(spec).groupBy(*spec.dimensions).agg(*[_aggregate(f, c) for f, c in spec.measures])

    def materialize(self, spec: Spec, path: str) -> Materialization:
        """Store an aggregate; AVG measures are stored as SUM and COUNT."""
        stored: dict[tuple[str, str], None] = {}
        for f, c in spec.measures:
            stored.update({("sum", c): None, ("count", c): None} if f == "avg" else {(f, c): None})
        whole = Spec(spec.base, spec.joins, spec.dimensions, tuple(stored), spec.filters, spec.filter_columns)
        self.direct(whole).write.parquet(path)
        made = Materialization(whole, path, self.spark.read.parquet(path).count())
        self.known.append(made)
        return made

    def refresh(self, made: Materialization, path: str) -> Materialization:
        """Store it anew and let the new one answer."""
        self.known.remove(made)
        return self.materialize(made.spec, path)

    def find(self, spec: Spec) -> Materialization | None:
        fit = [m for m in self.known if self._covers(m.spec, spec)]
        return min(fit, key=lambda m: m.rows, default=None)

    @staticmethod
    def _covers(have: Spec, want: Spec) -> bool:
        if have.joined() != want.joined() or set(have.filters) - set(want.filters):
            return False
        if not (set(want.dimensions) | set(want.filter_columns)) <= set(have.dimensions):
            return False
        held = set(have.measures)
        return all(({("sum", c), ("count", c)} <= held) if f == "avg" else (f, c) in held for f, c in want.measures)

    def answer(self, spec: Spec) -> DataFrame:
        made = self.find(spec)
        if made is None:
            return self.direct(spec)
        df = self.spark.read.parquet(made.path)
        for f in set(spec.filters) - set(made.spec.filters):
            df = df.where(f)
        out = []
        for f, c in spec.measures:
            if f == "avg":
                out.append((F.sum(name("sum", c)) / F.sum(name("count", c))).alias(name(f, c)))
            else:
                again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[f]
                out.append(again(name(f, c)).alias(name(f, c)))
        return df.groupBy(*spec.dimensions).agg(*out)
