"""Batch job: a model-ready feature table of free-text notes, a row a document.

A study's notes are measured (lengths, shares of kinds of characters, words), gaps are filled with the exact median of their language,
values are scaled by the language's mean and deviation, and values beyond its quartile fences are counted, so that the table can
go to feature selection and classification as it is. The cohort is the document's quality label; documents of one source are on one
side of the split.

Output: Parquet, partitioned by ``lang``. The whole output is replaced by each run, so a rerun over the same tables gives the same rows.

Defined cases: a null text has no values and gets the medians; an empty text has counts and no shares; a missing or empty language
is ``und``; a language without a single value of a feature has null for it; a feature that does not vary in a language is scaled to 0;
several labels of a document count as the greatest; a document without a label, or without an id, has no cohort; a null source is in the
training part; repeated rows stay; empty tables give an empty output.
"""

from __future__ import annotations

import functools
import string

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.scalar import exact_quantiles, safe_divide
from cohortloom.session import broadcast_if_small, settled

from .common import LOG, main

FEATURES = ("n_chars", "n_words", "n_lines", "mean_word", "distinct_share", "digit_share", "upper_share", "punct_share")
#: Bytes of a kind; in UTF-8 they are never part of another character. Words are runs of characters other than white space.
_KINDS = {"_white": b"\t\n\x0b\x0c\r ", "_digit": string.digits.encode(), "_upper": string.ascii_uppercase.encode(), "_punct": string.punctuation.encode()}
_COUNTS = ("n_words", "n_lines", "_distinct", *_KINDS)


def _count(batches):
    """COUNTS of whole texts in place of their bytes, the last column."""
    for batch in batches:
        found = []
        for data in batch.column("_bytes").to_pylist():
            words = data.split() if data is not None else []  # by ASCII white space
            found.append([None] * len(_COUNTS) if data is None else [len(words), data.count(b"\n") + 1, len(set(words)), *(len(data) - len(data.translate(None, kind)) for kind in _KINDS.values())])
        counts = [pa.array([row[k] for row in found], pa.int64()) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], *_COUNTS])


def measure(documents: DataFrame) -> DataFrame:
    """``documents`` with a column for each of FEATURES, from whole texts, in place of the texts. Each text is gone through once, in Arrow batches."""
    rows = documents.withColumns({"n_chars": F.length("text").cast("bigint"), "_bytes": F.col("text").cast("binary")}).drop("text")
    kinds = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes[:-1], *((c, "bigint") for c in _COUNTS)])
    shares = {
        "mean_word": safe_divide(F.col("n_chars") - F.col("_white"), F.col("n_words")),
        "distinct_share": safe_divide(F.col("_distinct"), F.col("n_words")),
        **{f"{kind}_share": safe_divide(F.col(f"_{kind}"), F.col("n_chars")) for kind in ("digit", "upper", "punct")},
    }
    return rows.mapInArrow(_count, kinds).withColumns(shares).drop("_distinct", *_KINDS).withColumns({f: F.col(f).cast("double") for f in FEATURES})


def language_scales(measured: DataFrame) -> DataFrame:
    """A row a language: of each feature the exact quartiles, and mean and deviation once gaps hold the median."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES])
    long = measured.select("lang", F.explode(cells).alias("x")).select("lang", "x.*")
    quartiles = exact_quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["lang", "feature"])
    sums = long.groupBy("lang", "feature").agg(F.count_if(F.col("v").isNull()).alias("gaps"), F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    both = sums.join(quartiles, ["lang", "feature"], "left")
    # Mean and variance of n values with the median added once for each gap.
    total = F.col("n") + F.col("gaps")
    mean = (F.col("n") * F.col("m") + F.col("gaps") * F.col("q50")) / total
    squares = F.col("n") * (F.col("s2") + F.pow(F.col("m") - mean, F.lit(2))) + F.col("gaps") * F.pow(F.col("q50") - mean, F.lit(2))
    scaled = both.select("lang", "feature", "q25", "q50", "q75", mean.alias("mean"), F.sqrt(squares / total).alias("sd"))
    at = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"_{c}_{f}")
    return scaled.groupBy("lang").agg(*[at(f, c) for f in FEATURES for c in ("q25", "q50", "q75", "mean", "sd")])


def with_cohort(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with ``cohort``. Rows without an id do not take part in the join, so they do not meet in one task."""
    best = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("cohort"))
    known = documents.filter("doc_id is not null").join(best, "doc_id", "left")
    return known.unionByName(documents.filter("doc_id is null").withColumn("cohort", F.lit(None).cast("int")))


def run(spark: SparkSession, documents: str, labels: str, output: str, fence: float = 1.5, test_share: int = 5) -> DataFrame:
    """Write the feature table of ``documents`` to ``output`` and return it as read back."""
    rows = spark.read.parquet(documents).select("doc_id", "text", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("und")).alias("lang"), "source")
    # Texts are measured once; what follows reads the numbers.
    measured = settled(measure(rows), "text-features")
    LOG.info("read %d documents from %s, %d without text", *measured.agg(F.count("*"), F.lit(documents), F.count_if(F.col("n_chars").isNull())).first())
    scales = broadcast_if_small(settled(language_scales(measured), "text-scales"))
    joined = with_cohort(measured, spark.read.parquet(labels).select("doc_id", "quality")).join(scales, "lang", "left")
    beyond, columns = [], {}
    for f in FEATURES:
        low, high = F.col(f"_q25_{f}"), F.col(f"_q75_{f}")
        beyond.append(F.coalesce(~F.col(f).between(low - fence * (high - low), high + fence * (high - low)), F.lit(False)).cast("int"))
        filled = F.coalesce(F.col(f), F.col(f"_q50_{f}"))
        columns[f"z_{f}"] = F.when(F.col(f"_sd_{f}") > 0, (filled - F.col(f"_mean_{f}")) / F.col(f"_sd_{f}")).when(F.col(f"_sd_{f}") == 0, 0.0)
    side = F.conv(F.substring(F.md5(F.col("source").cast("binary")), 1, 8), 16, 10).cast("bigint") % test_share == 0
    out = joined.select("doc_id", "source", "cohort", F.when(side, "test").otherwise("train").alias("split"), functools.reduce(lambda a, b: a + b, beyond).alias("n_beyond"), *[c.alias(n) for n, c in columns.items()], "lang")
    # Rows of a language are brought together and large ones split again by size, so files are neither tiny nor huge.
    out.hint("rebalance", F.col("lang")).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").parquet(output)
    written = spark.read.schema(out.schema).parquet(output)
    for r in written.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test")).orderBy("lang").collect():  # a row a language
        LOG.info("wrote %d rows of language %s to %s, %d of them for testing", r.n, r.lang, output, r.test)
    return written


if __name__ == "__main__":
    main(run, "text_features.json", ("documents", "labels", "output"))
