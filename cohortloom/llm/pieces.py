"""SentencePiece encoding and decoding for merge-type (BPE) models: exact ids by backtracking over longest matches.

Merging from single characters gives each text one sequence of tokens, and a sequence is that one exactly if its first token
and every two adjacent tokens come out again when their characters alone are merged. So a text is encoded from left to right: at
each position the longest vocabulary entry is tried (Aho-Corasick, run over the reversed text so that matches are known by their
start), then its ever shorter prefixes, until one is compatible with the token before it. A position from which nothing
leads on is marked in a bitfield, the token that led there is taken back and its next shorter prefix is tried; as the tokens up to a
position are unique, no marked position is tried again, and time grows with the text's length. Re-merged pairs are remembered.

Where characters meet that no entry joins, a text is cut into chunks that merge by themselves; ids of short chunks are remembered
too, up to a bound.

Defined cases: null text is empty and has no ids; empty ids, or null, decode to the empty string; characters outside the vocabulary
become the ids of their UTF-8 bytes if the model has them, else unknown ids, neighbours as one; repeated rows are encoded each; an empty
table gives an empty result; other columns stay, but for one named like the new column, which is replaced.
Models with user-defined or unused pieces, or of another type, raise ValueError.
"""

from __future__ import annotations

import array
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SPACE = "▁"
_CACHE_CHUNKS = 400_000
_CACHE_PAIRS = 1_000_000
_CACHE_CHARS = 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Ids of whole texts under one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(m.is_unused(i) for i in plain):
            raise ValueError(f"{path} has unused pieces")
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(m.is_byte(i) for i in self.byte_ids)
        self.unknown = m.unk_id()
        self.shorter = {}
        entries = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.shorter[piece] = next(piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.ids)
                entries.add_word(piece[::-1], piece)
        if self.shorter:
            entries.make_automaton()
        self.entries = entries if self.shorter else None
        self.chunks = self._chunk_pattern()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.short = functools.lru_cache(maxsize=_CACHE_CHUNKS)(self.encode_chunk)
        self._check(path)

    def _chunk_pattern(self) -> re.Pattern:
        """Runs of characters of one class, with spaces before them: characters are of one class if a chain of entries has them side by
        side, so no entry reaches from one class into another. Where an entry has a space after another character, all is one class."""
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.shorter):
            return re.compile(".+", re.DOTALL)
        of: dict[str, list[str]] = {}
        for piece in self.shorter:
            for a, b in itertools.pairwise(piece.lstrip(SPACE)):
                x, y = sorted((of.setdefault(a, [a]), of.setdefault(b, [b])), key=len)
                if x is not y:
                    y.extend(x)
                    of.update(dict.fromkeys(x, y))
        classes = sorted({id(x): x for x in of.values()}.values(), key=len, reverse=True)
        runs = [f"{SPACE}*[{re.escape(''.join(sorted(x)))}]+" for x in classes]
        return re.compile("|".join([*runs, f"{SPACE}*[^{SPACE}]|{SPACE}+"]), re.DOTALL)

    def _check(self, path: str) -> None:
        """User-defined pieces are matched before anything is merged, and other model types do not merge: both give other ids here."""
        for piece in itertools.islice(self.shorter, 0, None, max(1, len(self.shorter) // 500)):
            if self(piece) != self.model.encode(piece):
                raise ValueError(f"{path} is not a plain merge-type model: {piece!r}")

    def merge(self, text: str) -> list[str]:
        """The tokens of a short string, by merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in score]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``; an empty ``left`` is the start."""
        if len(self.pairs) >= _CACHE_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return fits

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text of any length, by backtracking."""
        n, shorter, known, compatible = len(text), self.shorter.get, self.pairs.get, self.compatible
        longest = {}
        if self.entries is not None and n > 1:
            # Of the matches of one end the longest comes first, so read backwards it is the one that stays.
            longest = dict(reversed(list(self.entries.iter(text[::-1]))))
        failed, out, at, before = bytearray(n // 8 + 1), [], 0, ""
        token = longest.get(n - 1) or text[:1] or None
        while at < n:
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = known((before, token))
                    if compatible(before, token) if fits is None else fits:
                        break
                token = shorter(token)
            if token is not None:
                out.append(token)
                at, before = end, token
                token = longest.get(n - 1 - at) or text[at : at + 1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = shorter(last := out.pop())
                at -= len(last)
                before = out[-1] if out else ""
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """The chunk's ids as 32-bit integers in native order."""
        out: list[int] = []
        for token in self.tokens(chunk):
            known = self.ids.get(token)
            if known is not None:
                out.append(known)
            elif self.has_bytes:
                out.extend(self.byte_ids[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return array.array("i", out).tobytes()

    def packed(self, text: str) -> bytes:
        """The text's ids as 32-bit integers in native order."""
        chunks = self.chunks.findall(self.model.normalize(text))
        if max(map(len, chunks), default=0) <= _CACHE_CHARS:
            found = map(self.short, chunks)
        else:
            found = [self.short(c) if len(c) <= _CACHE_CHARS else self.encode_chunk(c) for c in chunks]
        out = b"".join(found)
        if not self.has_bytes:  # neighbouring unknown characters are one
            ids = np.frombuffer(out, np.int32)
            out = ids[(ids != self.unknown) | np.concatenate(([True], ids[:-1] != self.unknown))[: len(ids)]].tobytes()
        return out

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """The process keeps its encoder, and the chunks and pairs it has met, from task to task."""
    return PieceEncoder(path)


def _with_column(df: DataFrame, name: str, source: str, kind, make) -> DataFrame:
    """``df`` and a column ``name``, made of the column ``source`` by ``make`` batch after batch."""
    kept = [c for c in df.columns if c != name]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias("_source"))
    schema = StructType([*rows.drop("_source").schema.fields, StructField(name, kind)])

    def run(batches):
        for batch in batches:
            made = make(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], made], [*kept, name])

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text, without begin and end ids."""

    def make(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(model_path or default_model())
        found = [encoder.packed(text or "") for text in texts.to_pylist()]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return _with_column(df, ids_col, text_col, ArrayType(IntegerType()), make)


def decode(df: DataFrame, model_path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that each row's ids stand for."""

    def make(ids: pa.Array) -> pa.Array:
        encoder = encoder_of(model_path or default_model())
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return pa.array([encoder.decode(values[a:b].tolist()) for a, b in itertools.pairwise(ends)], pa.string())

    return _with_column(df, text_col, ids_col, StringType(), make)
