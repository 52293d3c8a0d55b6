"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

Every window of ``width`` item words (a shorter item is one window) must be contained whole, so of its words ordered
by document frequency the prefix that any match must share is the rarest one. Document words that equal an indexed
prefix word propose the window at the one position it could stand; length and position bounds go first, then the
words are compared exactly.

Items are indexed in blocks of about ``block_windows`` windows, so what a task holds is bounded however large the
benchmark is: documents stream past one block without a shuffle, and are written between blocks. Rarity is counted over
all documents.

Defined cases: null text has no words; an item without words has no window; repeated items and documents are rows of
their own; empty tables give no hits or no rows; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, each_row

#: Separators become spaces and A-Z lower case; every byte of a non-ASCII character belongs to a word.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
BLOCK_WINDOWS = 200_000


def words(data: bytes | None) -> list[bytes]:
    return data.translate(_WORDS).split() if data else []


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, window): the window's words joined by spaces."""

    def cut_up(batches):
        for batch in batches:
            ids, found = [], []
            for item, data in zip(batch.column("item").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = words(data)
                if own:
                    grams = {b" ".join(own[k : k + width]) for k in range(max(1, len(own) - width + 1))}
                    ids += [item] * len(grams)
                    found += grams
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "window"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(cut_up, "item string, window binary").distinct()


def document_frequency(documents: DataFrame, vocabulary, text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each word of a bounded vocabulary stands."""
    held = documents.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        seen = Counter()
        for batch in batches:
            for data in batch.column("data").to_pylist():
                if data:
                    seen.update(held.value.intersection(words(data)))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = documents.select(F.col(text_col).cast("binary").alias("data")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in each_row(counted, "frequency")}


def index_block(windows: list[tuple[str, bytes]], frequency: dict[bytes, int]) -> dict:
    """{prefix word: {(its offset, window length): {window: [items]}}}"""
    index: dict = defaultdict(lambda: defaultdict(dict))
    for item, window in windows:
        own = window.split(b" ")
        offset = min(range(len(own)), key=lambda k: (frequency.get(own[k], 0), own[k], k))
        index[own[offset]][offset, len(own)].setdefault(window, []).append(item)
    return {w: dict(x) for w, x in index.items()}


def match(own: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans [start, end) of the windows that occur, and their items."""
    spans, items = [], set()
    if own and not index.keys().isdisjoint(own):
        n = len(own)
        for at, word in enumerate(own):
            if word in index:
                for (offset, length), held in index[word].items():
                    start = at - offset
                    if start >= 0 and start + length <= n and (hit := held.get(b" ".join(own[start : start + length]))):
                        spans.append((start, start + length))
                        items.update(hit)
    return spans, items


def covered(spans) -> int:
    total = at = 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, at))
        at = max(at, e)
    return total


def _indexes(documents: DataFrame, items: DataFrame, width: int, text_col: str, item_col: str, item_text_col: str, block_windows: int):
    """Broadcast indexes, one a block of at most about ``block_windows`` windows, and whether another follows."""
    windows = cut(item_windows(items, width, item_col, item_text_col), "windows")
    n_blocks = max(1, math.ceil(windows.count() / block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(n_blocks)))
    for k in range(n_blocks):
        block = [(r.item, bytes(r.window)) for r in windows.filter(F.col("block") == k).toLocalIterator()]
        frequency = document_frequency(documents, {w for _, x in block for w in x.split(b" ")}, text_col) if block else {}
        yield documents.sparkSession.sparkContext.broadcast(index_block(block, frequency)), k + 1 < n_blocks


def contamination(documents: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(id, n_words, n_hit, items): items are the ids, as strings in order, whose windows occur."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"), F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    for held, more in _indexes(documents, items, width, text_col, item_col, item_text_col, block_windows):

        def look(batches, held=held):
            for batch in batches:
                n_words, spans, found = [], batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for at, data in enumerate(batch.column("data").to_pylist()):
                    own = words(data)
                    n_words.append(len(own))
                    s, i = match(own, held.value)
                    if s:
                        spans[at] = spans[at] + [x for pair in s for x in pair]
                        found[at] = sorted(i.union(found[at]))
                cols = [batch.column("id"), batch.column("data"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "data", "n_words", "spans", "items"])

        rows = rows.mapInArrow(look, kinds)
        if more:  # one block's index at a time
            rows = cut(rows, "block")
            held.unpersist()

    def close(batches):
        for batch in batches:
            hit = [covered(zip(x[::2], x[1::2], strict=True)) for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(hit, pa.int64()), batch.column("items")], ["id", "n_words", "n_hit", "items"])

    return rows.drop("data").mapInArrow(close, f"id {dict(rows.dtypes)['id']}, n_words bigint, n_hit bigint, items array<string>").withColumnRenamed("id", id_col)


def keep_clean(documents: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents, as they are, in which no window of an item occurs; a null text holds none, rows that repeat all stay or
    all go, other columns play no part."""
    kinds, rows = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes), documents
    for held, more in _indexes(documents, items, width, text_col, item_col, item_text_col, block_windows):

        def look(batches, held=held):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([not match(words((t or "").encode("utf-8", "replace")), held.value)[0] for t in texts], pa.bool_()))

        rows = rows.mapInArrow(look, kinds)
        if more:
            rows = cut(rows, "block")
            held.unpersist()
    return rows
