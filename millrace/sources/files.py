"""File sources: formats with the engine's options, implicit columns, listings."""

from __future__ import annotations

import csv
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from millrace.sources.work import Files


def _letters(n: int) -> list[str]:
    """Column names of a text file without header: A ... Z, AA, AB ..."""
    out = []
    for i in range(n):
        name, i = "", i + 1
        while i:
            i, r = divmod(i - 1, 26)
            name = string.ascii_uppercase[r] + name
        out.append(name)
    return out


def text(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', escape: str = '"', comment: str | None = None, header: bool = False, skip: int = 0, array: bool = False, schema: str | None = None) -> DataFrame:
    """Delimited text.  Without header columns are A, B, C ...; ``array`` gives one array column ``columns``."""
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", escape).option("header", header)
    if comment:
        reader = reader.option("comment", comment)
    if schema:
        reader = reader.schema(schema)
    if skip:
        # ids rise by one from line to line of a file's block, so a line's number is its distance from the block's first
        block = ["_metadata.file_path", "_metadata.file_block_start"]
        lines = spark.read.text(path).select("value", F.col(block[0]).alias("_file"), F.col(block[1]).alias("_at"), F.monotonically_increasing_id().alias("_id"))
        begin = lines.where("_at = 0").groupBy("_file").agg(F.min("_id").alias("_first"))  # one row a file
        lines = lines.join(begin, "_file").withColumn("_row", F.when(F.col("_at") == 0, F.col("_id") - F.col("_first")).otherwise(F.lit(2**40))).where(F.col("_row") >= skip)
        first = lines.orderBy("_row").select("value").first()
        width = len(next(csv.reader([first[0]], delimiter=delimiter, quotechar=quote))) if first else 0
        named = next(csv.reader([first[0]], delimiter=delimiter, quotechar=quote)) if first and header else _letters(width)
        body = lines.where(F.col("_row") > skip) if header else lines
        parsed = F.from_csv("value", schema or ", ".join(f"`{n}` string" for n in named), {"sep": delimiter, "quote": quote, "escape": escape})
        df = body.select(parsed.alias("r")).select("r.*")
    else:
        df = reader.csv(path)
    if not header and not schema:
        df = df.toDF(*_letters(len(df.columns)))
    return df.select(F.array(*df.columns).alias("columns")) if array else df


def json_lines(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line).option("prefersDecimal", False)
    return (reader.schema(schema) if schema else reader).json(path)


def write_text(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, quote: str = '"', null: str = "", codec: str = "none", partition_by: tuple[str, ...] = ()) -> None:
    """Delimited text, a file per task; nulls as ``null``."""
    writer = df.write.option("sep", delimiter).option("header", header).option("quote", quote).option("escape", quote).option("nullValue", null).option("compression", codec)
    writer.partitionBy(*partition_by).csv(path)


def write_json(df: DataFrame, path: str, nulls: bool = True, codec: str = "none", partition_by: tuple[str, ...] = ()) -> None:
    """A JSON object per line; null fields are written unless ``nulls`` is off."""
    df.write.option("ignoreNullFields", not nulls).option("compression", codec).partitionBy(*partition_by).json(path)


def write_parquet(df: DataFrame, path: str, row_group_bytes: int = 128 << 20, page_bytes: int = 1 << 20, codec: str = "zstd", bloom: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """Parquet with chosen row groups, pages, codec and Bloom filters; sorted within tasks, so that statistics can prune."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = df.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("compression", codec)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    # a filter is per row group and written at its greatest size (1 MB if not set): a quarter of a group has 16 bits for each 8-byte value
    writer = writer.option("parquet.bloom.filter.max.bytes", min(1 << 20, max(32, row_group_bytes // 4))) if bloom else writer
    writer.partitionBy(*partition_by).parquet(path)


def parquet_footer(spark: SparkSession, path: str, size: int) -> pq.FileMetaData:
    """A Parquet file's metadata, from its footer alone."""
    fs = Files(spark)
    end = int.from_bytes(fs.read_end(path, size, 8)[:4], "little") + 8
    return pq.read_metadata(pa.BufferReader(fs.read_end(path, size, end)))


def parquet(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    return spark.read.option("mergeSchema", merge).parquet(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (or streams) below a path, a file per task; the schema is the first file's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    first = found.first()
    if first is None:
        raise ValueError(f"no Arrow file in {path}")

    def opened(data: bytes):
        return (pa.ipc.open_file if data[:6] == b"ARROW1" else pa.ipc.open_stream)(pa.BufferReader(data))

    kind = from_arrow_schema(opened(bytes(first[0])).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from opened(content.as_py()).read_all().to_batches()

    return found.mapInArrow(run, kind)


def rows(spark: SparkSession, objects: list, schema: str | StructType) -> DataFrame:
    """Typed Python objects as a relation."""
    return spark.createDataFrame(objects, schema)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def query(spark: SparkSession, url: str, statement: str, **options: str) -> DataFrame:
    """A statement run by a remote database over JDBC."""
    return spark.read.format("jdbc").option("url", url).option("query", statement).options(**options).load()


def implicit(df: DataFrame, root: str, levels: int = 2) -> DataFrame:
    """dir0 ... (folders below ``root``), file_name, file_mtime, row_index of a file scan."""
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inner = F.regexp_extract(F.col("_metadata.file_path"), f"{base}/(.*)$", 1)
    parts = F.split(inner, "/")
    depth = F.size(parts) - 1
    dirs = [F.when(depth > i, F.get(parts, F.lit(i))).alias(f"dir{i}") for i in range(levels)]
    return df.select("*", *dirs, F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("file_mtime"), F.col("_metadata.row_index").alias("row_index"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, mtime, size of every file below a folder, without reading the files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
