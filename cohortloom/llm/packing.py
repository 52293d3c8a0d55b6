"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised once and cut at multiples of the sequence length. Only the histogram of piece lengths, one
count for each length, comes to the driver; lengths are placed longest first, each into the packs with most room,
by updating counts of packing patterns. A pattern's slots own ranges of ranks of their length, and pieces find their
slot by their rank among pieces of equal length. Ranks are counted in hashed buckets of about ``bucket_rows`` pieces, so that
a length that very many documents share is not ranked by one task.

Defined cases: null text is empty and gives the end id alone; repeated rows are packed as documents of their own;
an empty table gives an empty result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, env_threads_off

SEQUENCE = 2048
END_ID = 1
BUCKET_ROWS = 50_000
_CACHE_WORDS = 400_000
PIECES = "id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

# Characters for which word-by-word encoding is the same as encoding the text: up to U+017F, composed already,
# lower case one to one, white space plain. Other texts go to the tokenizer whole.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e¡-įı-ſ]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ª²³µ¹º¼-¾À-ÖØ-öø-ſ]+")

# What a tokenizer must do for word-by-word encoding to hold; texts go to any other whole.
_NORMALIZER = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
_SPLITTER = r"""Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"""


class _Words(dict):
    """Encoded words, kept up to a bound: when the young are many they become the old, and old words met again are young."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            # To the byte-level model a lower-case ASCII word is its own bytes: normaliser and splitter have nothing to do.
            ids = [t.id for t in self.model.tokenize(word)] if word.isascii() else self.tokenizer.encode(word, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        env_threads_off()
        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)
        self.by_word = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == (_NORMALIZER, _SPLITTER)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __call__(self, text: str) -> bytes:
        if not self.by_word or _OTHER.search(text) or ("<" in text and any(s in text for s in self.special)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, _WORD.findall(text.lower())))


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The process keeps its encoder, and the words it has met, from task to task."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(documents: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: each document's ids and the end id, cut at multiples of ``sequence``."""

    def encode(batches):
        encoder, tail, step = encoder_of(tokenizer_path or default_tokenizer()), struct.pack("<I", end_id), 4 * sequence
        for batch in batches:
            own, starts, lengths, sums, totals = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = memoryview(encoder(text or "") + tail)
                for at in range(0, len(data), step):
                    piece = data[at : at + step]
                    own.append(k)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, PIECES.format(dict(rows.dtypes)["id"]))


def _add(room: dict, r: int, pattern: tuple[int, ...], n: int) -> None:
    held = room.setdefault(r, {})
    held[pattern] = held.get(pattern, 0) + n


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how often each is used. Longest lengths first; each goes to the packs with most room."""
    room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for r in range(sequence, length - 1, -1):
            packs = room.get(r)
            while left and packs:
                pattern, n = packs.popitem()
                used = min(n, left)
                if used < n:
                    packs[pattern] = n - used
                left -= used
                _add(room, r - length, (*pattern, length), used)
        while left:  # nothing has room: open packs, filled with this length
            per = min(left, sequence // length)
            n = left // per
            _add(room, sequence - per * length, (length,) * per, n)
            left -= n * per
    return [(p, n) for r in sorted(room) for p, n in sorted(room[r].items())]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence id, offset, used length of the sequence), by first rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, n in patterns:
        offset, used = 0, sum(pattern)
        for length in pattern:
            out.setdefault(length, []).append((taken.get(length, 0), first, offset, used))
            taken[length] = taken.get(length, 0) + n
            offset += length
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(documents: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces with sequence_id, offset and the padded length of their sequence."""
    pieces = cut(token_pieces(documents, tokenizer_path, sequence, end_id, id_col, text_col), "pieces")
    # One number a length, and a row for every BUCKET_ROWS pieces: all that is collected.
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    n_buckets = [-(-histogram.get(k, 0) // bucket_rows) for k in range(sequence + 1)]
    parts = F.element_at(F.array(*[F.lit(max(1, n)) for n in n_buckets]), (F.col("length") + 1).cast("int"))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), parts).cast("int"))
    first = np.concatenate(([0], np.cumsum(n_buckets)))
    own = np.zeros(first[-1] + 1, np.int64)
    for r in keyed.groupBy("length", "bucket").count().collect():
        own[first[r.length] + r.bucket] = r["count"]
    # Ranks of a length begin at 0 in its first bucket.
    before = np.concatenate(([0], np.cumsum(own)[:-1]))
    base = before - np.repeat(before[first[:-1].clip(max=len(own) - 1)], np.diff(np.append(first[:-1], len(own))))
    held = documents.sparkSession.sparkContext.broadcast((first, base, slots(pack_histogram(histogram, sequence))))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32", "doc_tokens")))

    def place(batches):
        first, base, by_length = held.value
        for batch in batches:
            length, bucket, rank = (batch.column(c).to_numpy() for c in ("length", "bucket", "rank"))
            rank = rank - 1 + base[first[length] + bucket]
            ids, offsets, used = (np.empty(len(rank), np.int64) for _ in range(3))
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                own = by_length[int(value)]
                slot = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                ids[at], offsets[at], used[at] = slot[:, 1] + rank[at] - slot[:, 0], slot[:, 2], slot[:, 3]
            padded = np.where(used & (used - 1) == 0, used, sequence)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(ids), pa.array(offsets), pa.array(padded)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"])

    kind = dict(pieces.dtypes)["id"]
    return ranked.mapInArrow(place, PIECES.format(kind) + ", sequence_id bigint, offset bigint, padded_length bigint").withColumnRenamed("id", id_col)
