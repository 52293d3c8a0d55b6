"""Quality classifier: supervised subword embeddings.

Words and the byte n-grams of the whole text are hashed into buckets with learned vectors; a document is the mean of
its features' vectors, a softmax layer gives the class. numpy stochastic gradient descent trains it on the driver, on
at most ``max_train`` labelled rows (a documented bound; those with the least hash of their id, texts of more than
``max_bytes`` bytes left out). A linear output over
a mean is the mean of each bucket's output, so documents are scored with one table of a float a bucket.

Defined cases: null and empty texts score the bias alone; labels other than 0 and 1 and null ids are not learned from;
a doubly labelled id counts once, by its least label, and an id with several texts by the least; without labels of both kinds every score is the share of 1
(0.5 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_row, gram_hash, prefix_hash, span_hash

BUCKET_BITS = 18
GRAMS = (3, 4)
DIM = 8
MAX_TRAIN = 3000
MAX_BYTES = 1 << 20
EPOCHS = 6
RATE = 0.5


def features(text: bytes) -> np.ndarray:
    """Buckets of the words and byte n-grams of white-space-normal text."""
    own = text.split()
    if not own:
        return np.zeros(0, np.int64)
    line = b" " + b" ".join(own) + b" "
    prefix = prefix_hash(line)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    parts = [span_hash(prefix, gaps[:-1], gaps[1:] + 1), *(gram_hash(prefix, n) for n in GRAMS)]
    return (np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def train(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(a logit for each bucket, bias)."""
    share = float(np.mean(labels)) if labels else 0.5
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BUCKET_BITS, DIM), np.float32)) - 0.5) / DIM
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    if 0 < share < 1:
        rows = []
        for text in texts:
            at, n = np.unique(features(text), return_counts=True)
            rows.append((at.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
        total, step = epochs * len(rows), 0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at, weight = rows[k]
                lr = rate * (1 - step / total)
                step += 1
                mean = weight @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
                z = out @ mean + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[k]] -= 1
                if len(at):
                    # Each feature's share of the mean is small: its step is scaled up to the document's.
                    vectors[at] -= (lr * np.sqrt(len(at)) * weight)[:, None] * (p @ out)[None, :]
                out -= lr * np.outer(p, mean)
                bias -= lr * p
        return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])
    odds = min(max(share, 1e-3), 1 - 1e-3)
    return np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(odds / (1 - odds)))


def score(text: bytes, table: np.ndarray, bias: float) -> float:
    at = features(text)
    z = bias + (float(table[at].mean()) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def held_out(column: str, folds: int, fold: int):
    """Whether an id belongs to the held-out fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id", folds, fold))
    own = own.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = texts.filter(F.octet_length("text") <= max_bytes).join(F.broadcast(own), "id")  # own: max_train rows at most
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    data = [(bytes(r.text), int(r.y)) for r in sorted(each_row(rows, "training-rows"), key=lambda r: r.id)]
    return train([t for t, _ in data], [y for _, y in data])


def apply(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """(id, held_out, score, predicted)"""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table, bias = held.value
        for batch in batches:
            scores = [score(t or b"", table, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["id", "held_out", "score", "predicted"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("held_out", held_out("id", folds, fold))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
