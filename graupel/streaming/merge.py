"""Streams into keyed tables: every micro-batch is merged with the target, idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graupel.sources.store import latest


def stream_table(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def merge_stream(stream: DataFrame, target: str, keys: list[str], at: str, tie: str) -> DataFrame:
    """Runs the stream over all that is there and returns the table of latest rows by key.

    Batch n is reduced by key and written to its own folder, which a repeated batch overwrites; the table is the latest row over
    all folders. So a batch costs its own size, not the table's, and a replay changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, at, tie).write.mode("overwrite").parquet(f"{target}/data/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_merged(stream.sparkSession, target, keys, at, tie)


def read_merged(spark: SparkSession, target: str, keys: list[str], at: str, tie: str) -> DataFrame:
    return latest(spark.read.parquet(f"{target}/data").drop("batch"), keys, at, tie)


def window_counts(stream: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by time window and key; rows later than `late` behind the newest are not waited for."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("rows"))
