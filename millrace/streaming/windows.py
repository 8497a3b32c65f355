"""Time windows over streams, with the batch windows' meaning, and file ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.sources.work import shared


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumble(df: DataFrame, at: str, width: str, late: str | None = None) -> DataFrame:
    """Rows with their tumbling window; ``late`` sets the watermark of a stream."""
    return (df.withWatermark(at, late) if late else df).withColumn("w", F.window(at, width))


def hop(df: DataFrame, at: str, width: str, slide: str, late: str | None = None) -> DataFrame:
    return (df.withWatermark(at, late) if late else df).withColumn("w", F.window(at, width, slide))


def session(df: DataFrame, at: str, gap: str, late: str | None = None) -> DataFrame:
    return (df.withWatermark(at, late) if late else df).withColumn("w", F.session_window(at, gap))


def drain(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote."""
    spark, out = df.sparkSession, shared(df.sparkSession, label)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def whole(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out)  # complete mode: each batch is the whole result

    writer.foreachBatch(whole).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


class Pipe:
    """Auto-ingestion: files that arrive in a folder are loaded once each into a table folder."""

    def __init__(self, spark: SparkSession, folder: str, target: str, schema: StructType, format: str = "json"):
        self.spark, self.folder, self.target, self.schema, self.format = spark, folder, target, schema, format

    def run(self) -> DataFrame:
        """Load what is new and return the target."""
        stream = self.spark.readStream.schema(self.schema).format(self.format).load(self.folder)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{self.target}-pipe").trigger(availableNow=True).start(self.target).awaitTermination()
        return self.spark.read.schema(self.schema).parquet(self.target)
