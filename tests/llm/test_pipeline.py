"""Each stage and the whole pipeline against brute force on a small fixture."""

import numpy as np

import corpus_pipeline as pipeline
from cohortloom.llm import langid, packing, secrets
from cohortloom.llm.common import table

from .helpers import frame, rows, words
from .test_corpus_ops import brute_hits
from .test_join import shingles


def small_corpus(spark, path):
    benchmark = [(1, " ".join(words(14, 9))), (2, "w1 w2 w3")]
    texts = [" ".join(words(60, k)) for k in range(20)]
    texts += [texts[0], texts[1] + " tail", texts[2].upper(), texts[3] + " " + benchmark[0][1], "w5 token=abcdef99 " + texts[4], None, "", "12 34 !"]
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, benchmark


def test_pipeline(spark, tmp_path):
    texts, benchmark = small_corpus(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    columns = docs.columns
    steps = []
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(path := f"{tmp_path}/step{len(steps)}")
        docs = spark.read.parquet(path)
        steps.append(docs)
    assert all(s.columns == columns for s in steps[:-1])

    encoders = langid.Encoders(langid.fit(table(spark, str(tmp_path), "documents")))
    keep = {k for k, t in enumerate(texts) if not encoders.classify(t)[2]}
    assert set(rows(steps[0])) == keep and {25, 26, 27}.isdisjoint(keep)
    root = {}
    for a in sorted(keep):
        sa = shingles(texts[a], 5)
        near = [b for b in root if 100 * len(sa & shingles(texts[b], 5)) >= 80 * len(sa | shingles(texts[b], 5))]
        group = {root[b] for b in near} | {a}
        least = min(group)
        root = {b: least if r in group else r for b, r in root.items()} | {a: least}
    keep = {a for a, r in root.items() if a == r}
    assert set(rows(steps[1])) == keep and not {20, 21} & keep
    hits = brute_hits(texts, benchmark)
    keep = {a for a in keep if not hits[a][1]}
    assert set(rows(steps[2])) == keep and 23 not in keep
    got = rows(steps[3])
    assert set(got) == keep
    for k, r in got.items():
        assert r["text"] == (texts[k] if not secrets.find_secrets(texts[k]) else texts[k].replace("token=abcdef99", "[secret]"))
        assert r["n_chars"] == len(r["text"])
    encoder = packing.Encoder(packing.default_tokenizer())
    assert sum(r.length for r in steps[4].collect()) == sum(len(encoder(r["text"])) // 4 + 1 for r in got.values())
    assert sorted(map(str, pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset", "padded_length").collect())) == sorted(map(str, steps[4].drop("sequence_id", "offset", "padded_length").collect()))


def test_stages_take_empty_tables(spark, tmp_path):
    small_corpus(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert np.isfinite(langid.MARGIN)


def test_join_stage_with_repeated_and_null_ids(spark, tmp_path):
    """One row of each group stays, whatever its id; rows without words all stay; names may clash."""
    small_corpus(spark, tmp_path)
    one, other, far = (" ".join(words(60, k)) for k in (1, 2, 3))
    texts = [one, one, one + " tail", one, other, other + " x", other, far, far, None, None, "", " \n"]
    ids = [5, 5, 5, None, None, None, 9, None, None, 1, 1, None, None]
    docs = frame(spark, texts, ids)
    for n in ("_id", "row", "own_id", "own_key", "kept_id", "component", "n", "a.b"):
        docs = docs.withColumn(n, docs.lang)
    out = pipeline.join_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, (x for x in got if (x[1] or "").strip()))) == sorted(map(str, [(5, min((one, one + " tail"), key=lambda t: key_of(spark, t))), (9, other), (None, far)]))
    assert len([x for x in got if not (x[1] or "").strip()]) == 4


def key_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(cast(t as binary)) k").first().k


def test_stages_take_clashing_names(spark, tmp_path):
    small_corpus(spark, tmp_path)
    docs = table(spark, str(tmp_path), "documents")
    for n in ("_id", "data", "held_out", "findings", "words", "spans", "items", "length", "rank", "bucket", "_own"):
        docs = docs.withColumn(n, docs.lang)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        assert out.count() > 0
