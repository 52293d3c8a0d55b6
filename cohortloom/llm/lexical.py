"""Ranked lexical search: the best documents of every item, by a threshold-seeded join.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. With N documents of at least one term,
L terms in all, df documents that hold a term, tf its occurrences and n the document's terms, a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), its impact is (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L, and a document's
score is the sum of w times impact over the item's different terms, in integers.

Items are taken in blocks of a bounded number of (item, term) pairs; per block

1. documents are read once; each keeps its length and the counts of the block's terms (a table in the shared folder);
2. each term's ``k`` greatest impacts are found and its least and greatest among them stored;
3. w times the kth impact of any of its terms is a lower bound of an item's kth score, so the greatest of them is its threshold;
4. an item's terms are ordered by their greatest possible part of a score; the last ones, whose parts add up to less than the threshold, are
   pruned: a document that holds none but them cannot be among the best ``k``;
5. the others propose candidates, document by document. Those whose sum and the pruned terms' bound reach the threshold are scored
   exactly. A task keeps the ``k`` best of each item, and its own kth score raises the threshold as it goes;
6. the tasks' best are ranked.

No posting list is shuffled or held by one task: step 2 sends at most ``k`` rows a term and task, step 6 at most ``k`` an item and task.
What tasks get of the items is bounded by ``BLOCK_PAIRS``.

Defined cases: null and empty texts have no terms; an item without terms, or whose terms no document holds, has no rows; equal items rank
each for itself, and repeated documents too, so ids may repeat in a list; among equal scores the least id comes first and null ids
last; an empty table gives an empty result; other columns are ignored. Ids of documents are integers; ids of items may be of any type.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import cut, small_batches

BLOCK_PAIRS = 400_000
_LETTERS = bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
#: A-Z to a-z, other term bytes to themselves, all else to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _LETTERS else 32 for b in range(256))
POSTINGS = "doc_id bigint, n bigint, term array<int>, tf array<bigint>"


def terms_of(data: bytes | None) -> list[bytes]:
    return data.translate(_FOLD).split() if data else []


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """A row an item with its different terms, in order."""

    def run(batches):
        for batch in batches:
            own = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {dict(rows.dtypes)['item_id']}, terms array<binary>")


def _postings(documents: DataFrame, words: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """POSTINGS: of every document its number of terms and the counts of those in ``words``."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        number = shared.value.get
        for batch in batches:
            n, ends, term, tf = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                own = terms_of(text.as_py())
                counts = Counter(map(number, own))
                counts.pop(None, None)
                n.append(len(own))
                term.extend(counts)
                tf.extend(counts.values())
                ends.append(len(term))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                ["doc_id", "n", "term", "tf"],
            )

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, POSTINGS)


def term_bounds(postings: DataFrame, total: int, length: int, k: int) -> DataFrame:
    """Of each term that a document holds: df, the kth greatest impact (0 if fewer hold it), and the greatest."""
    m = F.expr(f"50 + cast((cast(50 as decimal(20, 0)) * n * cast({total} as decimal(19, 0))) div {max(length, 1)} as bigint)")
    cells = postings.select(m.alias("m"), F.explode(F.arrays_zip("term", "tf")).alias("x"))
    own = cells.select("x.term", F.expr("(1000000000 * x.tf) div (1000 * x.tf + 20 * m)").alias("impact"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))
    best = own.withColumn("place", place).filter(F.col("place") <= k).groupBy("term")
    best = best.agg(F.max("impact").alias("most"), F.max(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    return own.groupBy("term").agg(F.count("*").alias("df")).join(best, "term").select("term", "df", F.coalesce("kth", F.lit(0)).alias("kth"), "most")


class _Lists:
    """Values of each of many rows, one after another: row r has ``values[starts[r] : starts[r + 1]]``."""

    def __init__(self, rows: list[list[int]]):
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        self.values = np.fromiter((v for x in rows for v in x), np.int64, int(self.starts[-1]))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``rows``, and how many each has."""
        first, n = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return self.values[at], n


class Plan:
    """What a block's tasks need: weights, thresholds, and each item's proposing and pruned terms."""

    def __init__(self, items: list[list[int]], stats: dict[int, tuple[int, int, int]], n_terms: int, total: int, length: int, k: int):
        """items: the term numbers of each; stats: df, kth and greatest impact of a term."""
        self.k, self.total, self.length, self.n_items, self.n_terms = k, total, length, len(items), n_terms
        self.weight = np.zeros(n_terms, np.int64)
        for t, (df, _, _) in stats.items():
            self.weight[t] = weight(total, df)
        self.threshold = np.ones(len(items), np.int64)
        self.rest = np.zeros(len(items), np.int64)
        proposing: list[list[int]] = [[] for _ in range(n_terms)]
        pruned: list[list[int]] = []
        for i, own in enumerate(items):
            held = [t for t in own if t in stats]
            self.threshold[i] = max([1, *(int(self.weight[t]) * stats[t][1] for t in held)])
            part = {t: int(self.weight[t]) * stats[t][2] for t in held}
            order, rest = sorted(held, key=lambda t: (part[t], t)), 0
            cut_at = len(order)
            for at, t in enumerate(order):
                if rest + part[t] >= self.threshold[i]:
                    cut_at = at
                    break
                rest += part[t]
            pruned.append(order[:cut_at])
            self.rest[i] = rest
            for t in order[cut_at:]:
                proposing[t].append(i)
        self.proposing, self.pruned = _Lists(proposing), _Lists(pruned)


def _best_of_task(batches, plan: Plan):
    """The ``k`` best documents of each item among a task's postings, as (item, score, doc_id)."""
    k, bound = plan.k, plan.threshold.copy()
    best: dict[int, list[tuple[int, int]]] = {}
    score, here = np.zeros(plan.n_items, np.int64), np.zeros(plan.n_terms, np.int64)
    for batch in batches:
        ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lists = batch.column(2)
        ends, term, tf = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column(3).values.to_numpy()
        for row, (doc_id, n) in enumerate(zip(ids, lengths, strict=True)):
            t, f = term[ends[row] : ends[row + 1]], tf[ends[row] : ends[row + 1]]
            if not len(t):
                continue
            m = 50 + (50 * n * plan.total) // plan.length
            part = plan.weight[t] * ((1_000_000_000 * f) // (1000 * f + 20 * m))
            items, times = plan.proposing.take(t)
            score[:] = 0
            np.add.at(score, items, np.repeat(part, times))
            chosen = np.flatnonzero((score > 0) & (score + plan.rest >= bound))
            if not len(chosen):
                continue
            here[t] = part
            others, times = plan.pruned.take(chosen)
            np.add.at(score, np.repeat(chosen, times), here[others])
            here[t] = 0
            key = -(1 << 64) if doc_id is None else -doc_id
            for i in chosen[score[chosen] >= bound[chosen]].tolist():
                kept, own = best.setdefault(i, []), (int(score[i]), key)
                if len(kept) < k:
                    heapq.heappush(kept, own)
                else:
                    heapq.heappushpop(kept, own)
                if len(kept) == k:
                    bound[i] = max(bound[i], kept[0][0])
    for i, kept in best.items():
        ids = [None if key == -(1 << 64) else -key for _, key in kept]
        yield pa.RecordBatch.from_arrays([pa.array([i] * len(kept), pa.int32()), pa.array([s for s, _ in kept], pa.int64()), pa.array(ids, pa.int64())], ["item", "score", "doc_id"])


def rank(documents: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, those with a score above 0."""
    spark = documents.sparkSession
    small_batches(spark)
    own = cut(_item_terms(items, item_col, item_text_col), "item-terms")
    kind = own.schema["item_id"].dataType
    n_blocks = -(-(own.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_pairs)
    found = [f for b in range(n_blocks) if (f := _rank_block(documents, own.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)) == b), k, id_col, text_col, kind)) is not None]
    if not found:
        schema = StructType([StructField("item_id", kind), StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())])
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, found)


def _rank_block(documents: DataFrame, block: DataFrame, k: int, id_col: str, text_col: str, kind) -> DataFrame | None:
    """The ranking of one block's items, or None if there is nothing to rank."""
    spark = documents.sparkSession
    rows = block.collect()  # bounded by BLOCK_PAIRS
    words = {w: number for number, w in enumerate(sorted({bytes(w) for r in rows for w in r.terms}))}
    postings = cut(_postings(documents, words, id_col, text_col), "postings")
    total, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    stats = {r.term: (r.df, r.kth, r.most) for r in cut(term_bounds(postings, total, length, k), "term-bounds").collect()}  # a row a term of the block
    plan = spark.sparkContext.broadcast(Plan([[words[bytes(w)] for w in r.terms] for r in rows], stats, len(words), total, length, k))
    best = postings.mapInArrow(lambda batches: _best_of_task(batches, plan.value), "item int, score bigint, doc_id bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(number, r.item_id) for number, r in enumerate(rows)], StructType([StructField("item", IntegerType()), StructField("item_id", kind)]))
    out = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
    return cut(out, "ranked")
