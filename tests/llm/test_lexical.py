"""Lexical search against a plain loop over all documents: ties, nulls, repeated rows, blocks, few and many holders of a term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    own = [TERM.findall((t or "").translate(FOLD)) for _, t in docs]
    total, length = sum(1 for x in own if x), sum(map(len, own))
    df = Counter(w for x in own for w in set(x))
    out = []
    for item_id, text in items:
        scored = []
        for (doc_id, _), words in zip(docs, own, strict=True):
            tf, score = Counter(words), 0
            for w in set(TERM.findall((text or "").translate(FOLD))) & set(tf):
                m = 50 + (50 * len(words) * total) // length
                score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, n + 1, x[3], -x[0]) for n, x in enumerate(scored[:k])]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.rank(d, q, **options).collect()), key=repr)


def case(seed):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 60}" + r.choice(["", "", "é", "É"])
    docs = [(i, r.choice([" ", ", ", "\n"]).join(word() for _ in range(r.randrange(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(30)] + [(7, docs[7][1]), (None, "W1 w2"), (None, docs[5][1]), (500, None), (501, ""), (502, "?! --"), (503, "w1 " * 3000)]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(20)] + [(3, "w1 w1 W1"), (3, "w1 w1 W1"), (None, "w2"), (40, None), (41, "..."), (42, "nowhere"), (43, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_equals_scoring_everything(spark, k):
    docs, items = case(k)
    want = plain(docs, items, k)
    assert ranked(spark, docs, items, k=k) == want and want


def test_blocks_give_the_same(spark):
    docs, items = case(9)
    assert ranked(spark, docs, items, k=5, block_pairs=40) == plain(docs, items, 5)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == [] and ranked(spark, [(1, None), (2, "--")], items) == []
    assert ranked(spark, docs, items) == plain(docs, items, 50)


def test_a_term_that_nearly_all_hold_is_pruned():
    stats = {0: (990, 40_000_000, 50_000_000), 1: (60, 30_000_000, 50_000_000)}
    plan = lexical.Plan([[0, 1]], stats, 2, 1000, 100_000, 50)
    assert plan.threshold[0] == lexical.weight(1000, 60) * 30_000_000
    assert plan.pruned.take(np.array([0]))[0].tolist() == [0] and plan.proposing.take(np.array([1]))[0].tolist() == [0] and not len(plan.proposing.take(np.array([0]))[0])
