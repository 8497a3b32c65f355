"""Join forms beyond a plain ``df.join``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on IS NOT DISTINCT FROM keys; stays a hash or merge join."""
    on = None
    for a, b in keys:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return left.join(right, on, how)


def salted(large: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are dealt over ``salts`` partitions; ``small`` is repeated that often.

    For plans AQE cannot split, such as aggregates stacked on the join.  ``how``
    is inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("salting repeats the right side: only inner and left joins keep their meaning")
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [key, "_salt"], how).drop("_salt")


def ranges(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` with the ``spans`` that contain them (start <= at < end), by bins.

    A span lies in bins of its own size: ``width`` times the power of two that is
    at least its length, so it touches two of them at most, however long it is.
    A point is repeated once per size that occurs (some sixty at most), which turns
    the inequality into an equi-join; no nested loop over all pairs.  Spans or
    points with nulls, and spans without length, meet nothing.
    """
    number = lambda c: c.cast("timestamp").cast("double") if dict(points.dtypes).get(at, "").startswith("timestamp") else c.cast("double")
    taken = {*points.columns, *spans.columns}
    level, bin_ = (next(n for i in range(len(taken) + 1) if (n := f"_{name}{i}") not in taken) for name in ("level", "bin"))
    low, high = number(F.col(start)), number(F.col(end))
    sized = spans.where(high > low).withColumn(level, F.greatest(F.lit(0), F.ceil(F.log2((high - low) / width)).cast("int")))
    levels = sorted(r[0] for r in sized.select(level).distinct().collect())  # powers of two of a double: bounded
    size = F.lit(width) * F.pow(F.lit(2.0), F.col(level))
    s = sized.withColumn(bin_, F.explode(F.array_distinct(F.array(F.floor(low / size), F.floor(high / size)))))
    p = points.withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(bin_, F.floor(number(F.col(at)) / size))
    inside: Column = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return p.join(s, [level, bin_, *keys]).where(inside).drop(level, bin_)
