import hashlib
import random
from collections import Counter

import pytest

from cohortloom.llm import queries, repeats
from cohortloom.llm.common import table

from .helpers import frame, rows


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, width):
    """Words of each text in a run of ``width`` words that another row holds too; rows of one text hold it twice."""
    split = [(t or "").encode().lower().split() for t in texts]
    held = Counter(g for own in split for g in {tuple(own[k : k + width]) for k in range(len(own) - width + 1)})
    return [len({j for k in range(len(own) - width + 1) if held[tuple(own[k : k + width])] > 1 for j in range(k, k + width)}) for own in split]


def check(spark, docs, texts, ids, **kw):
    found = repeats.remove_repeats(docs, **kw).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found}
    want = dict(zip(ids, brute(texts, kw.get("length", 400)), strict=True))
    assert got == want
    assert {r.doc_id: r.n_repeat_words for r in found} == dict(zip(ids, brute_words(texts, kw.get("words", 50)), strict=True))


@pytest.mark.parametrize("seed", range(4))
def test_word_runs(spark, seed, monkeypatch):
    """Runs within one text do not count, copies and shared passages do; very long texts are ranked in parts."""
    monkeypatch.setattr(repeats, "_CHUNK", 40)
    monkeypatch.setattr(repeats, "_PART", 64)
    r = random.Random(seed)
    pool = [" ".join(r.choice(("a", "B", "é", "cc")) for _ in range(r.randrange(2, 14))) for _ in range(10)]
    texts = [None, "", "a " * 60, "x y " * 30, "q w e r t z u i", *["  ".join(r.choice(pool) for _ in range(r.randrange(1, 9))) for _ in range(40)]]
    texts += texts[5:8] + [texts[9].upper(), texts[10] + " " + texts[11], "z " * 3 + "a " * 9]
    check(spark, frame(spark, texts).repartition(3), texts, range(len(texts)), length=40, window=17, words=8, step=3)


def test_query(spark, tmp_path):
    """The registered query, with rows that clash in name, a null text and a planted passage of 50 words below 400 bytes."""
    r = random.Random(3)
    mess = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = mess(50)
    texts = [None, mess(90), mess(30) + " " + passage, passage + " " + mess(40), mess(120), mess(500)]
    texts.append(texts[5])
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op10_repeats(spark, str(tmp_path)))
    for k, (n, removed, spans, sha) in enumerate(brute(texts, 400)):
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (n, removed, spans, sha)
    assert [got[k]["n_repeat_words"] for k in range(7)] == [0, 0, 50, 50, 0, 500, 500]


def test_production_length(spark, sf):
    docs = table(spark, sf, "documents")
    data = docs.select("doc_id", "text").collect()
    check(spark, docs, [r.text for r in data], [r.doc_id for r in data])


@pytest.mark.parametrize("seed", range(6))
def test_random_overlaps(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 50)
    r = random.Random(seed)
    pool = ["".join(r.choice("abé") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    texts = [None, "", "x" * 100, "ab" * 60, *["".join(r.choice(pool) for _ in range(r.randrange(1, 7))) for _ in range(40)]]
    texts += texts[4:7] + ["y" * 39, "y" * 40, "q" * 20 + texts[5]]
    check(spark, frame(spark, texts).repartition(3), texts, range(len(texts)), length=40, window=8)


def test_one_passage_in_many(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 100)
    r = random.Random(1)
    mess = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    passage = mess(70)
    texts = [mess(r.randrange(50)) + passage + mess(r.randrange(50)) for _ in range(80)]
    check(spark, frame(spark, texts).repartition(4), texts, range(len(texts)), length=40, window=8)


def test_empty_and_null_ids(spark):
    assert repeats.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0
    docs = frame(spark, ["a" * 500, "b", "b" * 450 + "c"], [None, None, 3])
    assert sorted(r.n_removed for r in repeats.remove_repeats(docs).collect()) == [0, 450, 500]


def test_long_texts_of_few_bytes(spark):
    """Every start is a range of its own there: millions of spans of one text."""
    texts = [(1, "x" * 3_000_000), (2, "xy" * 700_000), (3, "z" * 399), (4, "abc" * 100_000 + "d"), (5, None)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: (3_000_000, 3_000_000, 1), 2: (1_400_000, 1_400_000, 1), 3: (399, 0, 0), 4: (300_001, 300_000, 1), 5: (0, 0, 0)}
