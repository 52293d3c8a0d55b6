"""Incremental job: each subject's visits with the change from baseline, kept up to date as event files arrive.

New files are taken by a file stream that stops when there is nothing new. Each batch is summed up by subject, visit day and measure, and the
sums are written below the checkpoint under the batch's number, so a batch that is tried again replaces what it wrote. Then
the visits of those buckets of subjects that the batch touched are put together from all sums, and their partitions of the output are
replaced. Late events of earlier days, also ones before the baseline, are thus counted; untouched buckets are not read.

Output: Parquet, partitioned by ``bucket`` of subjects: subject, visit, measure, visit_no, n_events, n_values, mean, low, high,
baseline, change, pct_change. The baseline is the mean of the subject's first visit that has a value of the measure.

Defined cases: events without a subject or a time are no visit and are logged; a null measure is ``unknown``; a null value (or NaN) counts as an
event and not as a value; a visit without values has no mean and no change; a percentage of a baseline of 0 is null; a file
counts once, repeated rows within files as often as they stand there. Output and checkpoint belong together, and so does the number
of buckets: to start anew, remove both. ``events`` is a folder or a pattern, as file streams take no single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import nulls_for_nan, safe_divide
from cohortloom.streaming.visits import visit_stream

from .common import LOG, main

SUMS = "subject bigint, visit date, measure string, n_events bigint, n_values bigint, total double, low double, high double, batch bigint, bucket int"
VISITS = "subject bigint, visit date, measure string, visit_no int, n_events bigint, n_values bigint, mean double, low double, high double, baseline double, change double, pct_change double, bucket int"


def visit_sums(events: DataFrame, buckets: int) -> DataFrame:
    """Sums that can be added up: a row a subject, visit day and measure."""
    rows = nulls_for_nan(events.filter("user_id is not null and ts is not null").select(F.col("user_id").cast("bigint").alias("subject"), F.to_date("ts").alias("visit"), F.coalesce("event_type", F.lit("unknown")).alias("measure"), F.col("value").cast("double").alias("value")))
    sums = rows.groupBy("subject", "visit", "measure").agg(F.count("*").alias("n_events"), F.count("value").alias("n_values"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return sums.withColumn("bucket", F.pmod(F.xxhash64("subject"), F.lit(buckets)).cast("int"))


def visits_of(sums: DataFrame) -> DataFrame:
    """VISITS from sums of any number of batches. A subject has as many rows as visit days and measures, not as events."""
    keys = ["bucket", "subject", "visit", "measure"]
    whole = sums.groupBy(*keys).agg(F.sum("n_events").alias("n_events"), F.sum("n_values").alias("n_values"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = whole.withColumn("mean", safe_divide(F.col("total"), F.col("n_values")))
    in_order = Window.partitionBy("bucket", "subject", "measure").orderBy("visit")
    whole = whole.withColumns({"visit_no": F.row_number().over(in_order), "baseline": F.first("mean", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    change = F.col("mean") - F.col("baseline")
    return whole.select("subject", "visit", "measure", "visit_no", "n_events", "n_values", "mean", "low", "high", "baseline", change.alias("change"), safe_divide(100 * change, F.col("baseline")).alias("pct_change"), "bucket")


def replace_parts(df: DataFrame, path: str, *parts: str) -> None:
    """Write ``df``, replacing those partitions of ``path`` that it has rows for."""
    df.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def take_batch(batch: DataFrame, number: int, output: str, checkpoint: str, buckets: int) -> None:
    """Take one batch of new events; taking it again changes nothing."""
    spark, held = batch.sparkSession, f"{checkpoint}/sums"
    replace_parts(visit_sums(batch, buckets).withColumn("batch", F.lit(number).cast("bigint")), held, "batch", "bucket")
    sums = spark.read.schema(SUMS).parquet(held)
    touched = {r.bucket: r.n for r in sums.filter(F.col("batch") == number).groupBy("bucket").agg(F.sum("n_events").alias("n")).collect()}  # at most ``buckets`` rows
    LOG.info("batch %d: read %d events of subjects of %d buckets, and %d without subject or time", number, sum(touched.values()), len(touched), batch.filter("user_id is null or ts is null").count())
    if not touched:
        return
    of_touched = F.col("bucket").isin(list(touched))
    replace_parts(visits_of(sums.filter(of_touched)), output, "bucket")
    LOG.info("batch %d: wrote %d visits in %d of %d buckets to %s", number, spark.read.schema(VISITS).parquet(output).filter(of_touched).count(), len(touched), buckets, output)


def run(spark: SparkSession, events: str, output: str, checkpoint: str, buckets: int = 64, files_per_batch: int = 1000, schema: str | None = None) -> DataFrame:
    """Take what is new in ``events``, bring ``output`` up to date and return it as read back. schema: of events; else read from the files."""
    stream = visit_stream(spark, events, schema or spark.read.parquet(events).schema, maxFilesPerTrigger=files_per_batch)
    query = stream.writeStream.foreachBatch(lambda batch, number: take_batch(batch, number, output, checkpoint, buckets)).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("took %d batches", sum(1 for p in query.recentProgress if p["numInputRows"]))
    return spark.read.schema(VISITS).parquet(output)


if __name__ == "__main__":
    main(run, "visit_changes.json", ("events", "output", "checkpoint"))
