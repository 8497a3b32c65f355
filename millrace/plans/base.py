"""How a query is declared: what runs on Spark, and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_query(tables: list[str], text: str, oracle: str | None = "same") -> Query:
    """Spark SQL over the named tables; the oracle is the same text unless given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **{t: load(spark, sf_dir, t) for t in tables})

    return Query(run, text.replace("@", "") if oracle == "same" else oracle)


def frame_query(build: Callable[..., DataFrame], tables: list[str], oracle: str | None) -> Query:
    """``build`` gets one DataFrame per named table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*[load(spark, sf_dir, t) for t in tables])

    return Query(run, oracle)
