"""Helpers shared by the operators: shared-folder tables, 64-bit span hashes, connected components."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of 4 MB: executors keep their memory for the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cohortloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def each_row(df: DataFrame, name: str) -> Iterator[Row]:
    """The rows of ``df`` in no fixed order, a part at a time, from a table written down. To Spark a query that is iterated over ends when the
    iterator stands: where shuffle files go with the query, tasks would look for files that are gone. A table's scan has none."""
    return cut(df, name).toLocalIterator()


_CLEAN_UP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove a query's shuffle files when the query ends, not when the driver collects garbage."""
    for key in _CLEAN_UP:
        if spark.conf.isModifiable(key):  # get with a default gives that default for any key that is not set
            spark.conf.set(key, "true")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """``free_shuffles`` for what is written inside; then the session's own settings hold again, as its user may iterate over queries."""
    before = {key: spark.conf.get(key, None) for key in _CLEAN_UP if spark.conf.isModifiable(key)}
    free_shuffles(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# Span hashes: a polynomial prefix hash modulo 2^64 gives the hash of any byte span from two array reads.

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_U = np.uint64


def _splitmix(n: int, seed: int = 0) -> np.ndarray:
    z = (np.arange(1 + seed, n + 1 + seed, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.uint64)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE = (_splitmix(256) | _U(1), _splitmix(256, 256) | _U(1))
_POW = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def _powers(n: int, base: int = 0) -> list[np.ndarray]:
    """Powers of a base and of its inverse; two independent bases give ranks of 128 bits."""
    if len(_POW[base][0]) < n:
        size = 1 << max(14, (n - 1).bit_length())
        for k, step in enumerate((_BASES[base], pow(_BASES[base], -1, 1 << 64))):
            powers = np.full(size, step, np.uint64)
            powers[0] = 1
            _POW[base][k] = np.cumprod(powers)
    return _POW[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def prefix_of(values: np.ndarray, base: int = 0) -> np.ndarray:
    """The prefix hash of a sequence of 64-bit values."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum(values * _powers(n + 1, base)[0][:n], out=out[1:])
    return out


def prefix_hash(data: bytes, base: int = 0) -> np.ndarray:
    return prefix_of(_BYTE[base][np.frombuffer(data, np.uint8)], base)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end): equal contents give equal hashes, wherever they stand."""
    inverse = _powers(len(prefix), base)[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """span_hash of every window of ``width`` bytes, in order."""
    n = len(prefix) - 1 - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[width:] - prefix[:n]) * _powers(len(prefix))[1][:n] + _U(width))


def word_shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are runs of bytes other than ASCII white space, A-Z in lower case."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.concatenate((gaps, [len(line)]))
    if len(words) > width:
        start, end = start[: len(words) - width + 1], end[width - 1 :]
    else:
        start, end = start[:1], end[-1:]
    return np.unique(span_hash(prefix_hash(line), start, end))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


HOT_SHARE = 1000
SALTS = 64


def hot_keys(groups: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Keys that hold more than a thousandth of all rows: at most ``HOT_SHARE`` of them. groups: a row a key, with ``n`` rows."""
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return groups.filter(F.col(n) * HOT_SHARE > total).select(*on)


def salted_join(rows: DataFrame, payload: DataFrame, on: list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``payload``, a row a key, by ``on``. Rows of hot keys are dealt to ``SALTS`` tasks by ``spread``, and
    what those keys bring is repeated as often, so no task gets all rows of one key. Join columns that ``spread`` cannot tell
    apart stay together."""
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))  # HOT_SHARE rows at most
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)
    left = rows.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = payload.join(marked, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (id, component), component the least id reached.

    Alternates large-star and small-star steps until the edges are stars around their least member. Hubs with
    very many edges only take part in a pre-aggregated minimum and a join that Spark can split.
    """
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct()
    e, state = cut(e, "edges"), None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        state = tuple(mark)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u > v").distinct(), "edges")


def env_threads_off() -> None:
    """Tokenizer threads would oversubscribe executor cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
