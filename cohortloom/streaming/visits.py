"""Newly arriving visit rows as a stream (beyond what batch studies need)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def visit_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
