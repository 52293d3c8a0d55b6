"""Language identification by compression: each language has a raw-content zstandard dictionary, a text belongs to the
language whose dictionary encodes it in the fewest bytes.

Texts are encoded whole, in lower case and in blocks, each block against the dictionary anew. Code lengths are compared as likelihoods:
the score is the best language's share. A text whose best and second code lengths lie within ``margin`` of each other
is rejected. Dictionaries come from a bounded sample of labelled rows (``per_language`` different texts with the least
hashes, ``dictionary_bytes`` bytes a language).

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the language
with most learned rows, then by name; without any learned language everything is ``und``; repeated rows give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_row, small_batches
from .quality import held_out

UNKNOWN = "und"
PER_LANGUAGE = 300
DICTIONARY_BYTES = 96 << 10
BLOCK = 8 << 10
LEVEL = 9
MARGIN = 0.003
_LETTER = re.compile(r"[^\W\d_]")


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """Lines of the texts in turn, distinct, in lower case, up to ``size`` bytes; what zstandard finds cheapest stands at the end."""
    queues = [iter(dict.fromkeys(re.split(r"(?<=[.!?\n])\s+", t.lower()))) for t in texts]
    seen, parts, total = set(), [], 0
    for line in itertools.chain.from_iterable(itertools.zip_longest(*queues)):
        if line and line not in seen:
            seen.add(line)
            data = line.encode("utf-8", "replace") + b" "
            parts.append(data)
            total += len(data)
            if total >= size:
                break
    return b"".join(reversed(parts))[-size:]


class Encoders:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard

        self.names = list(dictionaries)
        self.encoders = []
        for data in dictionaries.values():
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> np.ndarray:
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return np.array([sum(len(e.compress(b)) for b in blocks) for e in self.encoders], np.int64)

    def classify(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if text is None or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text.lower().encode("utf-8", "replace"))
        best = int(np.argmin(sizes))
        share = np.exp2(-8.0 * np.minimum(sizes - sizes[best], 100))
        second = np.partition(sizes, 1)[1] if len(sizes) > 1 else 2 * sizes[best] + 1
        return self.names[best], float(1 / share.sum()), bool(second - sizes[best] <= margin * sizes[best])


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, fold: int = 1, per_language: int = PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, the language with most learned rows first."""
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id", folds, fold))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = [(r["n"], r.different, r.lang) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).collect()]
    counts.sort(key=lambda x: (-x[0], x[2]))
    # Of each language's different texts those with the least hashes: a share that holds enough of them comes to the driver,
    # as hashes, and the ranks decide. What a dictionary can hold of a text is what it may give.
    reach = {lang: min(1.0, 4 * per_language / max(1, different)) for _, different, lang in counts}
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(share * (2.0**63 - 1024)))) for lang, share in reach.items()], F.lit(-1)) if counts else F.lit(-1)
    least = F.shiftrightunsigned("h", 1)
    drawn: dict[str, list] = {}
    for r in rows.filter(least <= below).select("lang", "h").distinct().collect():
        drawn.setdefault(r.lang, []).append(r.h)
    chosen = [(lang, h) for lang, hs in drawn.items() for h in sorted(hs, key=lambda h: (h & (1 << 64) - 1) >> 1)[:per_language]]
    texts: dict[str, list] = {}
    if chosen:
        held = rows.sparkSession.createDataFrame(chosen, "lang string, h bigint")  # per_language rows a language
        for r in each_row(rows.join(F.broadcast(held), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.left("text", F.lit(dictionary_bytes))).alias("text")), "drawn"):
            texts.setdefault(r.lang, []).append((r.h, r.text))
    dictionaries = {lang: build_dictionary([t for _, t in sorted(texts[lang])], dictionary_bytes) for _, _, lang in counts if lang in texts}
    return {k: v for k, v in dictionaries.items() if v}


def apply(documents: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, folds: int = 3, fold: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score, rejected)"""
    held = documents.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        encoders = Encoders(held.value)
        for batch in batches:
            out = [encoders.classify(t, margin) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "held_out", "lang_pred", "score", "rejected"])

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("id", folds, fold))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def keep_identified(documents: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents that are not rejected, as they are; one pass without a shuffle."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(dictionaries)
    kinds = ", ".join(f"`{n}` {t}" for n, t in documents.dtypes)

    def run(batches):
        encoders = Encoders(held.value)
        for batch in batches:
            mask = [not encoders.classify(t, margin)[2] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return documents.mapInArrow(run, kinds)
