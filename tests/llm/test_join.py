import random

import numpy as np
import pytest

from cohortloom.llm import ngramjoin
from cohortloom.llm.common import components, table

from .helpers import frame, rows, words


def shingles(text, width):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))} if own else set()


def brute(texts, ids, width=4):
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(sets[k]), least[find(k)]) for k, i in enumerate(ids)}


def check(spark, docs, texts, ids):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(docs).collect()}
    assert got == brute(texts, list(ids))


def test_documents(spark, sf):
    docs = table(spark, sf, "documents")
    data = docs.select("doc_id", "text").collect()
    check(spark, docs, [r.text for r in data], [r.doc_id for r in data])


def families(seed, n=25, copies=6):
    """Texts of many sizes with edits around the threshold."""
    r = random.Random(seed)
    out = [None, "", " \n", "one", "one two", "One  TWO", "a b c", "a b c d", "a b c d e"]
    for k in range(n):
        base = words(r.choice([4, 6, 9, 12, 16, 22, 30, 45, 70, 120, 400]), seed * 1000 + k, 50 if k % 3 else 4000)
        out.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, 1 + max(1, len(base) // 25))):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1, 1, 2])] = [f"z{r.randrange(9)}"]
            if r.random() < 0.3:
                own += words(r.randrange(1, 2 + len(own) // 8), r.randrange(99))
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("seed", "small"), [(1, 24), (2, 2), (3, 1), (4, 24), (5, 3)])
def test_families(spark, seed, small, monkeypatch):
    texts = families(seed)
    # SMALL is read on the workers: a value of its own goes with the function there.
    monkeypatch.setattr(ngramjoin, "_shared", _with_small(small))
    check(spark, frame(spark, texts).repartition(3), texts, range(len(texts)))


def _with_small(small):
    import cohortloom.llm.ngramjoin as m

    plain = m._shared

    def run(batches):
        import cohortloom.llm.ngramjoin as own

        own.SMALL = small
        yield from plain(batches)

    return run


def test_signatures_lose_no_link():
    r = np.random.default_rng(3)
    for _ in range(1500):
        size = int(r.choice([1, 3, 6, 7, 10, 20, 24, 26, 40, 90, 300]))
        a = r.integers(0, 1 << 63, size, np.int64).view(np.uint64)
        out, new = r.integers(0, max(1, size // 10) + 1), r.integers(0, max(1, size // 10) + 1)
        b = np.concatenate((a[out:], r.integers(0, 1 << 63, new, np.int64).view(np.uint64)))
        shared, union = len(a) - out, len(a) + new
        if len(b) and 100 * shared >= 85 * union:
            assert np.intersect1d(ngramjoin.signatures(np.unique(a)), ngramjoin.signatures(np.unique(b))).size


def test_empty_and_null_ids(spark):
    assert ngramjoin.join(frame(spark, ["a"]).limit(0)).count() == 0
    got = ngramjoin.join(frame(spark, ["a b c d e f", "a b c d e f", "q", "q"], [None, 7, None, None])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 3, 7), (7, 3, 7)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = rows(components(spark.createDataFrame(edges, "a long, b long")), "id")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: v["component"] for k, v in got.items()} == {k: find(k) for a, b in edges if a != b for k in (a, b)}


def test_long_sketches_keep_links(spark):
    """Large sets, on both sides of a doubling, keep their links and lose what is far apart."""
    r = random.Random(6)
    base = words(1100, 77, 100_000)
    texts = [" ".join(base), " ".join(base[:1000]), " ".join(base[60:] + words(20, 5)), " ".join(base[:500] + words(600, 9, 100_000)), " ".join(words(1100, 78, 100_000))]
    for _ in range(4):
        own = list(base)
        for _ in range(r.choice([20, 40, 60])):
            own[r.randrange(len(own))] = "zz"
        texts.append(" ".join(own))
    check(spark, frame(spark, texts), texts, range(len(texts)))


def test_small_groups_send_a_row_a_member():
    """Twenty near copies in thirty groups of the same members: one group, and a row a member instead of 190 pairs."""
    import pyarrow as pa

    sigs, keys = np.repeat(np.arange(30), 20), np.tile(np.arange(20), 30)
    found = pa.Table.from_batches(ngramjoin._shared([pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(keys)], ["sig", "key"])]))
    once = found.group_by(["sig", "a"]).aggregate([])
    assert once.num_rows == 20
    columns = {"sig": once["sig"].combine_chunks(), "key": pa.array(np.arange(20)), "size": pa.array([100] * 20), "part": pa.array([0] * 19 + [7])} | {q: pa.array([5] * 20) for q in ngramjoin._Q}
    batch = pa.RecordBatch.from_pydict(columns)
    firsts = pa.Table.from_batches(ngramjoin._firsts([batch])).to_pydict()
    assert sorted(zip(firsts["a"], firsts["b"], strict=True)) == [(k, 0) for k in range(20)]
    left = pa.Table.from_batches(ngramjoin._proposals([batch])).to_pydict()
    assert sorted(zip(left["a"], left["b"], strict=True)) == [(19, k) for k in range(19)]


def test_long_texts_with_common_lines_do_not_meet(spark, monkeypatch):
    """Half of each text are lines that all hold: no two link, and none is grouped or proposed."""
    r = random.Random(8)
    pool = [" ".join(words(20, k, 100_000)) for k in range(30)]
    texts = [" ".join(r.sample(pool + [" ".join(words(20, 1000 * k + i, 100_000)) for i in range(30)], 60)) for k in range(1, 31)]
    plain, made = ngramjoin.cut, {}

    def cut(df, name):
        out = plain(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(ngramjoin, "cut", cut)
    check(spark, frame(spark, texts), texts, range(len(texts)))
    assert made["shared"] == made["groups"] == made["firsts"] == 0


def test_sets_with_frequent_features(spark, monkeypatch):
    """Features of more than two sets count as frequent: PartEnum's signatures take their place and lose no link."""
    texts = families(6)
    monkeypatch.setattr(ngramjoin, "SMALL", 2)
    check(spark, frame(spark, texts).repartition(3), texts, range(len(texts)))


@pytest.mark.parametrize("often", [4, 1000])
def test_features_are_counted_across_batches(often, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngramjoin, "_OFTEN", often)
    r = np.random.default_rng(1)
    sig = np.sort(r.integers(0, 60, 300))
    key, sets = np.arange(300), np.bincount(sig)
    for step in (1, 2, 7, 300):
        batches = [pa.RecordBatch.from_pydict({"sig": sig[k : k + step], "key": key[k : k + step], "size": key[k : k + step] + 5}) for k in range(0, 300, step)]
        got = pa.Table.from_batches(ngramjoin._frequencies(batches)).to_pylist()
        assert [(x["key"], x["size"], x["df"], x["sig"]) for x in got] == [(k, k + 5, min(often, sets[s]), s) for k, s in zip(key.tolist(), sig.tolist(), strict=True) if sets[s] > 1]
        # The first look: key 7 of a feature comes twice, from equal texts; a row without a key says that several hold it.
        rows = [(1, 7), (1, 7), (2, 7), (2, 8), (3, None), (3, 9), (4, 9), (5, None)]
        look = [pa.RecordBatch.from_arrays([pa.array(x) if n < 2 else pa.nulls(len(x), pa.int64()) for n, x in enumerate(([s for s, _ in part], pa.array([k for _, k in part], pa.int64()), part))], ["sig", "key", "need"]) for part in (rows[k : k + step] for k in range(0, len(rows), step))]
        found = pa.Table.from_batches(ngramjoin._shared_counts(look)).group_by("key").aggregate([("shared", "sum")]).to_pydict()
        assert dict(zip(found["key"], found["shared_sum"], strict=True)) == {7: 1, 8: 1, 9: 1}
