"""Suffix-array deduplication by distributed prefix doubling: bytes covered by a string of ``length`` bytes that starts
anywhere else as well, and words covered by a run of ``words`` words that stands in another text as well.

A position's rank is a hash of the string that stands there. Spark sorts positions by rank; positions whose rank is unique
are done, the others are ranked anew by a longer string, pairs of neighbouring ranks growing until they are unique or
reach the full length. Doubling from every byte would sort a row a byte in its first round. It starts from
anchors instead: of every ``window`` consecutive grams of ``length - window + 1`` bytes the one with the least hash, the
leftmost of several. Equal strings of ``length`` bytes have the same anchor at the same place, so nothing is missed.

Each anchor owns the strings of which it is the anchor, a range of starts. A round sorts (rank of what all strings of the
range have in common, rank of all that the range covers, text, position):

* a unique common rank: none of the strings repeats, the range is done;
* a shared covering rank: all its strings repeat, the range is done;
* else the range is open, and is cut into cells ``STEP`` times smaller, whose strings have more in common. The last
  round has cells of one string.

Ranks of coverings have 128 bits. Tasks combine equal ranks before the shuffle, so a passage that very many documents
share sends few rows. Word runs go through the same rounds, with words in place of bytes; they count as repeated only
where two different texts hold them, copies of one text being one.

Equal texts share a 64-bit key and are handled once; copies (equal by SHA-256 too) of at least ``length`` bytes are removed
whole, and all words of copies of at least ``words`` words are repeated. Defined cases: null text is empty; texts shorter
than ``length`` keep all bytes; repeated rows are copies of one another; null ids keep their row; an empty table gives an
empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gram_hash, hot_keys, mix, prefix_hash, prefix_of, salted_join, signed, span_hash

LENGTH = 400
WINDOW = 201
WORDS = 50
WORD_WINDOW = 40
STEP = 15
_CHUNK = 400_000
_PART = 1 << 20
_ROW = "kind byte, h bigint, e bigint, f bigint, key bigint, pos int, reach int, multi boolean"
_ROW_NAMES = ["kind", "h", "e", "f", "key", "pos", "reach", "multi"]
_ROW_KINDS = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
_SPAN = "kind byte, key bigint, family byte, pos int, first int, last int, multi boolean"
_SPAN_NAMES = ["kind", "key", "family", "pos", "first", "last", "multi"]
_SPAN_KINDS = [pa.int8(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
BYTES, RUNS = 0, 1  # families of strings; the last bit of a common rank
_SALT = np.uint64(0xA0761D6478BD642F)
_U = np.uint64


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The pick (np.minimum or np.maximum) of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class Sequence:
    """A text as units, with two independent prefix hashes for the ranks of its strings."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.n, self.first, self.second = len(first) - 1, first, second

    def rank(self, start, end):
        return span_hash(self.first, start, end)

    def covering(self, at, first, end):
        """128 bits for the units [first, end) around position ``at``."""
        place = mix((at - first).astype(_U) + _U(1))
        return signed(self.rank(first, end) ^ place), signed(span_hash(self.second, first, end, base=1) ^ place)


def byte_units(data: bytes) -> Sequence:
    return Sequence(prefix_hash(data), prefix_hash(data, base=1))


def word_units(data: bytes) -> Sequence:
    """Units are the words, runs of bytes other than ASCII white space, A-Z in lower case."""
    line = b" ".join(data.lower().split())
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
    values = span_hash(prefix_hash(line), start, end) if line else np.zeros(0, _U)
    return Sequence(prefix_of(values), prefix_of(mix(values ^ _SALT), base=1))


def owned(seq: Sequence, length: int, window: int) -> tuple[np.ndarray, ...]:
    """(anchors, their grams' ranks, first and last of the starts that each owns)"""
    gram = length - window + 1
    h = gram_hash(seq.first, gram)
    low = _sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, _U)
    anchors = np.flatnonzero(h == _sliding(np.concatenate((edge, low, edge)), window, np.maximum))
    # The owner can change where the least hash does, and behind an anchor.
    new = np.zeros(len(low) + 1, bool)
    new[0] = True
    new[1:-1] = low[1:] != low[:-1]
    new[anchors[anchors < len(low) - 1] + 1] = True
    new[-1] = False
    first = np.flatnonzero(new)
    own = np.searchsorted(anchors, first)
    while len(late := np.flatnonzero(h[anchors[own]] != low[first])):
        own[late] += 1
    other = np.concatenate(([True], own[1:] != own[:-1]))
    first, own = first[other], own[other]
    last = np.concatenate((first[1:] - 1, [len(low) - 1]))
    return anchors[own], h[anchors[own]], first, last


def _batch(names, kinds, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _pack(at, first, last):
    return ((at - first) * 65536 + (at - last)).astype(np.int32)


def _tagged(h: np.ndarray, family: int) -> np.ndarray:
    return signed((h & ~_U(1)) | _U(family))


def _spans(kind, h, key, pos, reach, multi):
    return _batch(_SPAN_NAMES, _SPAN_KINDS, (np.full(len(h), kind, np.int8), key, (h & 1).astype(np.int8), pos, pos - (reach >> 16), pos - (reach & 65535), multi))


def _groups(h, e, f):
    start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (e[1:] != e[:-1]) | (f[1:] != f[:-1]))))
    return start, np.diff(np.concatenate((start, [len(h)])))


def _repeats(h, key, start, size):
    """Which groups of equal coverings repeat: two strings; of words, in two texts (rows are sorted by text)."""
    return (size > 1) & ((h[start] & 1 == BYTES) | (key[start] != key[start + size - 1]))


def _combine(h, e, f, key, pos, reach, multi):
    """Rows of one chunk with equal ranks: all of those that repeat are spans (kind 1), one stands for them in the shuffle."""
    order = np.lexsort((pos, key, f, e, h))
    h, e, f, key, pos, reach, multi = (x[order] for x in (h, e, f, key, pos, reach, multi))
    start, size = _groups(h, e, f)
    every = np.repeat(_repeats(h, key, start, size) | np.logical_or.reduceat(multi, start), size)
    keep = ~every
    keep[start] = True
    out = [x[keep] for x in (h, e, f, key, pos, reach, every)]
    yield _batch(_ROW_NAMES, _ROW_KINDS, (np.zeros(len(out[0]), np.int8), *out))
    at = np.flatnonzero(every & ~multi)
    if len(at):
        none = np.zeros(len(at), np.int64)  # ranks say nothing more
        yield _batch(_ROW_NAMES, _ROW_KINDS, (np.ones(len(at), np.int8), h[at] & 1, none, none, key[at], pos[at], reach[at], np.ones(len(at), bool)))


class _Chunks:
    """Rows held until a chunk is full."""

    def __init__(self):
        self.held, self.count = [], 0

    def add(self, *columns):
        self.held.append(columns)
        self.count += len(columns[0])
        if self.count >= _CHUNK:
            yield from self.close()

    def close(self):
        if self.count:
            yield from _combine(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
        self.held, self.count = [], 0


def _parts(data: bytes, family: int, length: int, wanted=None):
    """(first start, units) of a text's strings; very long texts come in parts, which bound what a task holds."""
    if family == RUNS:
        units = word_units(data) if len(data) >= length else None
        if units is not None and units.n >= length:
            yield 0, units
        return
    for base in range(0, len(data) - length + 1, _PART) if wanted is None else wanted:
        yield base, byte_units(data[base : base + _PART + length - 1])


def first_round(docs: DataFrame, sizes: tuple[tuple[int, int, int], ...]) -> DataFrame:
    """Rows of all anchors, combined by chunk; docs: key, data; sizes: (family, length, window)."""

    def rank(batches):
        chunks, seen = _Chunks(), set()
        for batch in batches:
            for key, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for family, length, window in sizes:
                    for base, units in _parts(data, family, length):
                        at, h, first, last = owned(units, length, window)
                        e, f = units.covering(at, first, last + length)
                        yield from chunks.add(_tagged(h, family), e, f, np.full(len(at), key, np.int64), (at + base).astype(np.int32), _pack(at, first, last), np.zeros(len(at), bool))
                if not chunks.count:
                    seen = set()
        yield from chunks.close()

    return docs.mapInArrow(rank, _ROW)


def next_round(docs: DataFrame, sizes: tuple[tuple[int, int, int], ...], cell: int) -> DataFrame:
    """Rows of open ranges, cut into cells of ``cell`` strings at fixed distances from their anchors; docs: key, data, ranges."""

    def rank(batches):
        chunks = _Chunks()
        for batch in batches:
            for key, data, ranges in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                for family, length, _ in sizes:
                    own = np.array([(x["pos"], x["first"], x["last"], x["multi"]) for x in ranges if x["family"] == family], np.int64).reshape(-1, 4)
                    if not len(own):
                        continue
                    part = own[:, 1] // _PART * _PART if family == BYTES else np.zeros(len(own), np.int64)
                    for base, units in _parts(data, family, length, np.unique(part).tolist()):
                        pos, start, stop, multi = (own[part == base] - (base, base, base, 0)).T
                        far, near = (pos - start) // cell, (pos - stop) // cell
                        at = np.repeat(np.arange(len(pos)), far - near + 1)
                        number = np.arange(len(at)) - np.repeat(np.cumsum(far - near + 1) - far - 1, far - near + 1)
                        pos, multi = pos[at], multi[at].astype(bool)
                        end = pos - number * cell
                        first, last = np.maximum(start[at], end - (cell - 1)), np.minimum(stop[at], end)
                        common = units.rank(end, end - (cell - 1) + length)
                        e, f = units.covering(pos, first, last + length)
                        yield from chunks.add(_tagged(common ^ mix(number.astype(_U) + _U(cell)), family), e, f, np.full(len(at), key, np.int64), (pos + base).astype(np.int32), _pack(pos, first, last), multi)
        yield from chunks.close()

    return docs.mapInArrow(rank, _ROW)


def _settle(batches):
    """Reads rows sorted by (kind, h, e, f, key, pos); gives ranges whose strings repeat (kind 1) and open ones (kind 2: their
    common rank is shared, of equal coverings that repeat only one goes on, multi)."""
    carry, other = None, False  # rows of the last group, one if it repeats; whether its common rank had another covering before

    def settle(rows, before, final):
        nonlocal carry, other
        h, e, f, key, pos, reach, multi = rows
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (e[1:] != e[:-1]) | (f[1:] != f[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))
        at = np.flatnonzero(new)
        multi = np.logical_or.reduceat(multi, at)
        h, e, f, key, pos, reach = (x[at] for x in (h, e, f, key, pos, reach))
        start, size = _groups(h, e, f)
        again = _repeats(h, key, start, size) | np.logical_or.reduceat(multi, start)
        top = h[start]
        alike = top[1:] == top[:-1]
        siblings = np.concatenate(([before], alike)) | np.concatenate((alike, [False]))
        every = np.repeat(again, size)
        hit = np.flatnonzero(every & ~multi)
        if len(hit):
            yield _spans(1, h[hit], key[hit], pos[hit], reach[hit], np.ones(len(hit), bool))
        go = ~every
        go[start] = True
        if not final:
            other = bool(before if len(start) == 1 else alike[-1])
            s = start[-1]
            tail = np.flatnonzero(go[s:]) + s
            carry = [x[tail] for x in (h, e, f, key, pos, reach)] + [every[tail]]
            go[s:] = False
        at = np.flatnonzero(go & np.repeat(siblings, size))
        if len(at):
            yield _spans(2, h[at], key[at], pos[at], reach[at], every[at])

    for batch in batches:
        kind, h, e, f, key, pos, reach = (batch.column(c).to_numpy() for c in _ROW_NAMES[:-1])
        multi = batch.column("multi").to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kind == 1)
        if len(at):
            yield _spans(1, h[at], key[at], pos[at], reach[at], np.ones(len(at), bool))
        rows = [x[kind == 0] for x in (h, e, f, key, pos, reach, multi)]
        if len(rows[0]):
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            yield from settle(rows, other, False)
    if carry is not None:
        yield from settle(carry, other, True)


def _settled(ranked: DataFrame, name: str) -> DataFrame:
    """One round's sort by rank. What is settled already (kind 1) is spread by text."""
    dealt = ranked.repartition(F.when(F.col("kind") == 1, F.xxhash64("key", "pos")).otherwise(F.col("h")))
    return cut(dealt.sortWithinPartitions("kind", "h", "e", "f", "key", "pos").mapInArrow(_settle, _SPAN), name)


def merged(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings that start in ``spans`` (packed first << 32 | last)."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x >> 32, (x & 0xFFFFFFFF) + length) for x in spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(length: int, words: int):
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            size, removed, runs, kept, repeated = [], [], [], [], []
            for data, spans, copy in zip(*(batch.column(c).to_pylist() for c in ("data", "spans", "copy")), strict=True):
                n, spans = len(data), spans or []
                own = [(0, n)] if copy and n >= length else merged((x for x in spans if x >= 0), length)
                at, parts = 0, []
                for s, e in own:
                    parts.append(data[at:s])
                    at = e
                left = b"".join([*parts, data[at:]]) if own else data
                size.append(n)
                removed.append(n - len(left))
                runs.append(len(own))
                kept.append(left)
                total = len(data.split()) if copy else 0
                repeated.append(total if total >= words else sum(e - s for s, e in merged((~x for x in spans if x < 0), words)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(kept, pa.binary()), pa.array(repeated, pa.int64())], names)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, window: int = WINDOW, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, n_repeat_words): kept holds the bytes that remain; n_repeat_words counts the
    words of the whole text that lie in a run of ``words`` words which another document holds too."""
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")).withColumn("key", F.xxhash64("data"))
    sizes = ((BYTES, length, min(window, length)), (RUNS, words, min(WORD_WINDOW, words)))
    keys = docs.groupBy("key").agg(F.min("id").alias("carrier"))
    carried = lambda rows: docs.join(rows.withColumnRenamed("key", "r_key"), F.col("id").eqNullSafe(F.col("carrier")) & (F.col("key") == F.col("r_key")))

    rounds = [_settled(first_round(docs.select("key", "data"), sizes), "round")]
    cell = max(s[2] for s in sizes)
    while cell > 1:
        cell = -(-cell // step)
        ranges = rounds[-1].filter("kind = 2").groupBy("key").agg(F.collect_list(F.struct("family", "pos", "first", "last", "multi")).alias("ranges"))
        texts = carried(ranges.join(keys, "key")).select("key", "data", "ranges").dropDuplicates(["key"])
        rounds.append(_settled(next_round(texts, sizes, cell), "round"))

    packed = F.shiftleft(F.col("first").cast("bigint"), 32) + F.col("last")
    spans = None
    for rows in rounds:
        own = rows.filter("kind = 1").select("key", F.when(F.col("family") == RUNS, F.bitwise_not(packed)).otherwise(packed).alias("span"))
        spans = own if spans is None else spans.union(own)
    # A list, not a set: Java's hash of a packed span is first xor last, which is 0 for every range of one start.
    spans = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    # Copies are marked by id; other texts have one row, that of their carrier.
    texts = cut(docs.select("id", "key", F.unhex(F.sha2("data", 256)).alias("sha")), "texts")
    same = cut(texts.groupBy("key", "sha").agg(F.min("id").alias("carrier"), F.count("*").alias("n")), "same")
    copies = same.filter("n > 1").select("key", "sha", F.lit(True).alias("copy"))
    marks = salted_join(texts, copies, ["key", "sha"], hot_keys(same, ["key", "sha"]), ["id"]).select("id", "key", "copy").distinct()
    marks = marks.withColumn("spans", F.lit(None).cast("array<bigint>"))
    marks = marks.union(spans.join(same.filter("n = 1").select("key", "carrier"), "key").select("carrier", "key", F.lit(False), "spans"))
    m = marks.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "copy", "spans")
    rows = docs.join(m, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select("id", "data", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    return rows.mapInArrow(_cut(length, words), f"id {dict(docs.dtypes)['id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, n_repeat_words bigint").withColumnRenamed("id", id_col)
