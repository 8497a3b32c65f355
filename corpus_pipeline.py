"""The corpus pipeline: quality filter, exact dedup, near dedup, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and hands the reread table on.

Defined cases, of every stage: null, empty and very long texts pass as their operator
says (the docstrings of ``millrace.llm``); rows are told apart as rows, so null or
repeated ids drop nothing else; repeated rows are equal texts, of which one stays
from the second stage on; an empty table gives an empty table; columns other than
those of ``documents`` do not travel, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, mixing, neighbours, simhash
from millrace.llm.common import keep, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote rejects go."""
    ship(spark)
    return neighbours.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id goes on."""
    return exact_dedup.dedup(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints the document with the smallest id goes on."""
    ship(spark)
    return simhash.dedup(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat or go, so that each source comes near its target of words."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id, n_tokens, and digests of its ids and of their decoded text."""
    ship(spark)
    return bpe.encode(docs.select(*COLUMNS), digests=True)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("bpe", encode)]

#: SQL cannot express the classifier, the fingerprint graph or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
