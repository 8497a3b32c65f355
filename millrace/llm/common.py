"""What the training-data operators share: tables, the shared work folder, shipping.

Nothing here keeps state between queries.  Work tables go to a folder below
``spark.checkpoint.dir`` (every executor and the driver see it), never to a
machine-local path: a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh one is set only where none is (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or None
    if path is None:
        current = sc._jsc.sc().getCheckpointDir()
        path = os.path.dirname(current.get()) if current.isDefined() else None
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet work table in the shared folder and read it back.

    Cuts lineage at a point that outlives any executor.  The folder is unique
    per call, so reruns never read each other's rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or passed with ``--py-files``; this
    only adds the driver's own checkout to the workers' search path.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null id: fold of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hashed keys.

    A cut-off on the hash, from the number of rows, leaves about ``2 * n`` rows
    before the sort, so the task that merges the tasks' candidates stays small.
    """
    total = rows.count()
    if total > 2 * n + 1000:
        share = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
        rows = rows.where(share < (2 * n + 1000) / total)
    return rows.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 40)), key).limit(n)
