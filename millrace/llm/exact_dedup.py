"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

Pass 1 is a counting Bloom filter of one hash function, held sparsely: a 64-bit
cell per normalised text and how many rows fell into it.  Only cells travel (8 bytes and a count, combined
before the exchange), never texts or rows.  Cells met twice or more are set in
a register-blocked Bloom filter: one 64-bit word per cell, three bits inside it.

Pass 2 probes that filter on the map side.  Rows that miss are unique for
certain (a Bloom filter has no false negatives) and pass straight through
without an exchange; rows that hit, true repeats and a few false positives,
are the only ones that shuffle, on their SHA-256.

Scale: the filter has at most ``max_words`` 64-bit words whatever the input
(2**22 words, 64 MB of payload), which bounds the broadcast.  From about
2**26 repeated texts on (four set bits a word and hash) it saturates: more rows then
take the exchange, and the result stays the same.
A group holding a third of all rows is combined before the exchange where it
is aggregated, and split by the skew-join rule where it is joined back.

Defined cases: null text counts as empty, and all empty texts are one group;
a null id sorts after every other; of rows with the same text and the same id
exactly one is kept; an empty table gives an empty table; further columns are
ignored by ``annotate`` and carried whole by ``dedup``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, keep, table

BITS = 3


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of white space made one space."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _mask(cell: Column) -> Column:
    """Three bits of a 64-bit word, from hash bits that do not choose the word."""
    h = F.xxhash64(cell, F.lit(1))
    bit = [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bit]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


def _filter_of(repeated: DataFrame, n: int, max_words: int) -> tuple[DataFrame, int]:
    """The Bloom filter's words, and how many there can be."""
    words = 1 << 12
    while words < n and words < max_words:
        words *= 2
    out = (
        repeated.select(F.pmod("cell", F.lit(words)).alias("word"), _mask(F.col("cell")).alias("m"))
        .groupBy("word")
        .agg(F.bit_or("m").alias("bits"))
    )
    return out, words


def _repeated(cells: DataFrame) -> DataFrame:
    return keep(cells.groupBy("cell").count().where("count > 1").select("cell"), "dedup-cells")


def _probed(rows: DataFrame, cells: DataFrame, max_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are unique for certain, and rows that may be repeated.

    ``rows`` has a ``cell`` column; ``cells`` is where pass 1 counts.
    """
    repeated = _repeated(cells)
    words, n = _filter_of(repeated, repeated.count(), max_words)
    hit = (F.col("bits").isNotNull()) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    # size bound: at most max_words rows of two longs
    found = (
        rows.withColumns({"word": F.pmod("cell", F.lit(n)), "mask": _mask(F.col("cell"))})
        .join(F.broadcast(words), "word", "left")
        .withColumn("hit", F.coalesce(hit, F.lit(False)))
        .drop("word", "mask", "bits")
    )
    return found.where("not hit").drop("hit"), found.where("hit").drop("hit")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1 << 22) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    rows = keep(
        docs.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest")).select(
            "id", "digest", F.xxhash64("digest").alias("cell"), F.monotonically_increasing_id().alias("rid")
        ),
        "dedup-digests",
    )
    unique, maybe = _probed(rows, rows.select("cell"), max_words)
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))
    groups = maybe.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    # a table of its own, so that both sides of the join are plain exchanges and a huge group can be split
    groups = keep(groups, "dedup-groups")
    grouped = maybe.join(groups, "digest").select(
        "id", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "digest"
    )
    straight = unique.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return straight.unionByName(grouped).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1 << 22) -> DataFrame:
    """The rows that stay, all columns whole.

    Possibly repeated rows are reduced to one per text on the map side before
    they shuffle, so a huge group of copies sends one row per task.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest"), row)
    keyed = keyed.withColumn("cell", F.xxhash64("digest"))
    cells = docs.select(F.xxhash64(digest(F.col(f"`{text_col}`"))).alias("cell"))
    unique, maybe = _probed(keyed, cells, max_words)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    one = maybe.groupBy("digest").agg(F.min_by("row", order).alias("row"))
    return unique.select("row").unionByName(one.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
