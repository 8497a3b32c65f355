"""Connected components of a link table, by alternating large-star and small-star.

Each round rewrites the links with two grouped minima; links to a hub of any
size are combined before the exchange where minima are taken and are split by
the skew-join rule where they are joined back.  Nothing is collected but two
numbers a round, which tell whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep

ROUNDS = 500  # star contraction needs a few rounds, by the logarithm of the nodes; far beyond is a fault, and raised


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b longs) but the roots; a root is its component's least node."""
    links = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(links)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("low")), "links-low")
        far = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")).distinct()
        far = keep(far, "links-large")
        low = keep(far.groupBy("a").agg(F.min("b").alias("low")), "links-low")
        near = far.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = keep(near.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
