"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Semantics first, then scale: UTC timestamps, last map key wins, AQE with
#: skew handling on, runtime Bloom filters for selective joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str = "local[8]", app: str = "millrace", **extra: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark
