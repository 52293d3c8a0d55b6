"""Decontamination, packing, archives, fingerprints and classifiers."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import decontam, langid, packing, quality, queries, simhash, warc
from cohortloom.llm.common import table

from .helpers import frame, rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(texts, items, width=10):
    out = {}
    for k, text in enumerate(texts):
        own, hit, found = plain_words(text), set(), set()
        for item, body in items:
            w = plain_words(body)
            grams = [w[j : j + width] for j in range(max(1, len(w) - width + 1))] if w else []
            for g in grams:
                for at in range(len(own) - len(g) + 1):
                    if own[at : at + len(g)] == g:
                        hit.update(range(at, at + len(g)))
                        found.add(str(item))
        out[k] = (len(own), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, block):
    r = random.Random(4)
    items = [(k, " ".join(words(r.choice([1, 3, 10, 11, 14, 25]), k, 30))) for k in range(14)] + [(14, None), (15, "!!"), (3, "w1 w2"), (16, "THE the The the the the the the the the the")]
    texts = [None, "", "!!", "the " * 40]
    for k in range(60):
        own = words(r.randrange(40), 100 + k, 30)
        if k % 2:
            own[len(own) // 2 : len(own) // 2] = (r.choice(items)[1] or "").upper().split()
        texts.append(" - ".join(own))
    texts += texts[5:8]
    got = decontam.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == brute_hits(texts, items)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.contamination(frame(spark, texts), empty).collect()} == {0}


def check_packing(spark, docs, texts, **kw):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, **kw).collect()
    own, sequences = {}, {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own.pop(k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not own
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in got), len(sequences)


def test_packing(spark, sf):
    docs = table(spark, sf, "documents").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    used, n = check_packing(spark, docs, texts)
    assert used / (2048 * n) > 0.97


def test_packing_cases(spark):
    texts = [None, "", "a", "a", "x " * 5000, "İstanbul ΣΑΣ ǅ", "<|endoftext|> <b> it's 'Tis WE'LL", "½²³ ª º µ § a b\u0085c", "é é ­", "日本語 한국어", "a" * 3000]
    check_packing(spark, frame(spark, texts), texts)
    assert packing.pack(frame(spark, ["a"]).limit(0)).count() == 0
    # Lengths that many share are ranked in several buckets.
    texts = [w for w in ("a", "b c", None) for _ in range(50)] + texts
    check_packing(spark, frame(spark, texts), texts, bucket_rows=3)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("'stmdlrve<|> \n")), max_size=30))
def test_encoder(text):
    if not hasattr(test_encoder, "own"):
        test_encoder.own = packing.Encoder(packing.default_tokenizer())
    own = test_encoder.own
    assert own(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_the_histogram(counts):
    patterns = packing.pack_histogram(counts, 64)
    assert all(sum(p) <= 64 for p, _ in patterns)
    total = {}
    for p, n in patterns:
        for x in p:
            total[x] = total.get(x, 0) + n
    assert total == counts


def test_warc(spark, tmp_path):
    html = ["<p>é</p>", "", None, "<p>é</p>", "x" * 70_000, "a\r\n\r\nb", "<p>é</p>", "unique", ""]
    pages = spark.createDataFrame([(k, f"http://h/\n{k}" if k else None, h, "c") for k, h in enumerate(html)], "page_id long, url string, html string, id string")
    got = rows(warc.round_trip(pages.repartition(3)), "page_id")
    for k, h in enumerate(html):
        data = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if last == k else "revisit", None if last == k else last)
        assert tuple(got[k][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=100_000).collect()} == {"response"}


def test_warc_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 2000) for k in range(200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    raw = warc.write_archives(pages, folder)
    done = warc.normalise(raw, folder)
    path = done.first().archive
    data = open(path, "rb").read()
    import json

    for line in open(path + ".idx"):
        e = json.loads(line)
        gz = zlib.decompressobj(31)
        record = gz.decompress(data[e["offset"] : e["offset"] + e["length"]])
        assert gz.eof and not gz.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_simhash(spark):
    texts = [None, "", "one", "One!", "a b c d e", *[" ".join(words(n, n)) for n in (6, 60, 60, 300, 40_000)], "q"]
    ids = [*range(100, 110), None]
    got = rows(simhash.edited_fingerprints(frame(spark, texts, ids)))
    order = [*sorted(range(10), key=lambda k: -ids[k]), 10]
    for at, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(at + 1) % len(order)]] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[ids[k]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        other = got[ids[order[(at + 1) % len(order)]]]["fingerprint"]
        assert r["near_next"] == pytest.approx(1 - bin(int(r["fingerprint"], 16) ^ int(other, 16)).count("1") / 128)
        assert r["near_edited"] == pytest.approx(1 - bin(int(r["fingerprint"], 16) ^ int(r["edited_fingerprint"], 16)).count("1") / 128)
    assert got[106]["fingerprint"] == got[107]["fingerprint"] and got[100]["fingerprint"] == "0" * 32
    assert simhash.edited_fingerprints(frame(spark, ["a"]).limit(0)).count() == 0
    assert [r.near_next for r in simhash.edited_fingerprints(frame(spark, ["a b"])).collect()] == [1.0]


def test_simhash_votes(spark):
    """The packed lanes count what a plain loop counts."""
    text = " ".join(words(50, 1))
    r = spark.createDataFrame([(1, text)], "key long, text string")
    terms = r.select(simhash._shingles(simhash._term_arrays(r.text)).alias("t")).first().t
    votes = sum(np.array([1 if (t >> b) & 1 else -1 for b in range(64)]) for t in terms)
    want = sum(1 << b for b in range(64) if votes[b] > 0)
    assert int(simhash.fingerprints(r, ["key"]).first().fingerprint[:16], 16) == want


def test_near_search(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(128) for _ in range(40)]
    prints = base + [b ^ sum(1 << rnd.randrange(128) for _ in range(rnd.randrange(1, 6))) for b in base for _ in range(3)]
    df = spark.createDataFrame([(k, f"{p:032x}") for k, p in enumerate(prints)], "doc_id long, fingerprint string")
    got = {(r["query"], r.near) for r in simhash.near_search(df, df.limit(30), 3).collect()}
    want = {(f"{a:032x}", f"{b:032x}") for a in prints[:30] for b in prints if bin(a ^ b).count("1") <= 3}
    assert got == want
    counts = rows(simhash.with_near_counts(df, step=100))
    assert counts[0]["near_docs"] == sum(bin(prints[0] ^ b).count("1") <= 3 for b in prints) - 1 and counts[1]["near_docs"] is None


def test_simhash_query_counts_near_documents(spark, tmp_path):
    texts = [None, "", *[" ".join(words(300, 7)[: 290 + k]) for k in range(10)], *[" ".join(words(300, k)) for k in range(20, 30)]]
    texts += texts[2:5]
    frame(spark, texts, [100 * k if k % 2 else 100 * k + 1 for k in range(len(texts) - 1)] + [None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_simhash(spark, str(tmp_path)).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    assert len(got) == len(texts)
    for r in got:
        near = sum(bin(int(r.fingerprint, 16) ^ b).count("1") <= simhash.RADIUS for b in prints) - 1
        assert r.near_docs == (near if r.doc_id is not None and r.doc_id % 100 == 0 else None)
    assert max(r.near_docs or 0 for r in got) >= 8


def test_near_search_flips_bits(spark):
    """Four tables and flipped bits find what a loop over all pairs finds, up to the radius and no further."""
    rnd = random.Random(2)
    base = [rnd.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ sum(1 << k for k in rnd.sample(range(128), n)) for b in base for n in (3, 9, 10, 11, 12)]
    df = spark.createDataFrame([(k, f"{p:032x}") for k, p in enumerate(prints)], "doc_id long, fingerprint string")
    for radius in (3, 7, 11):
        got = {(r["query"], r.near) for r in simhash.near_search(df, df.limit(30), radius, blocks=4, kept=1).collect()}
        assert got == {(f"{a:032x}", f"{b:032x}") for a in prints[:30] for b in prints if bin(a ^ b).count("1") <= radius}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    docs = frame(spark, [None, "", "a"])
    labels = spark.createDataFrame([], "doc_id long, quality int, text string")
    assert {r.score for r in quality.apply(docs, quality.fit(docs, labels)).collect()} == {0.5}
    assert quality.apply(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    docs = table(spark, sf, "documents")
    model = langid.fit(docs)
    own = rows(langid.apply(frame(spark, [None, "", "12 !", "é"]), model))
    assert [own[k]["lang_pred"] for k in range(3)] == ["und"] * 3 and own[3]["lang_pred"] in model
    assert langid.apply(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    assert langid.keep_identified(docs, model).count() > 0.97 * docs.count()


def test_language_codes_are_plain_compression(spark):
    """The prediction is the language whose dictionary makes the shortest code, by a compressor set up anew for every block."""
    import zstandard

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs)
    got = rows(langid.apply(docs, model))
    for r in docs.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id]["lang_pred"] == "und"
            continue
        data, sizes = r.text.lower().encode(), {}
        for lang, held in model.items():
            d = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            blocks = [data[k : k + langid.BLOCK] for k in range(0, len(data), langid.BLOCK)]
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for b in blocks)
        order = list(model)
        assert got[r.doc_id]["lang_pred"] == min(order, key=lambda k: (sizes[k], order.index(k)))


def test_language_sample_is_bounded(spark):
    """Copies count once, so a language of copies is learned, and no more than ``per_language`` texts are drawn."""
    texts = ["der hund und die katze"] * 50 + [" ".join(words(30, k)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "de" if k < 50 else "xx") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=5)
    assert set(model) == {"de", "xx"} and model["de"] == b"der hund und die katze "
    assert 1 <= len(model["xx"].split()) <= 5 * 30


def test_quality_loop(spark):
    """The table of one float a bucket gives the score of the softmax over the mean vector."""
    texts, labels = [b"good fine text", b"bad junk junk", b"good and fine", b"junk bad"], [1, 0, 1, 0]
    table_, bias = quality.train(texts, labels, epochs=40)
    scores = [quality.score(t, table_, bias) for t in texts]
    assert [int(s > 0.5) for s in scores] == labels
    # The same steps, one feature at a time, softmax written out.
    rng = np.random.default_rng(7)
    vectors = (rng.random((1 << quality.BUCKET_BITS, quality.DIM), np.float32) - 0.5) / quality.DIM
    out, bias2, step = np.zeros((2, quality.DIM), np.float32), np.zeros(2, np.float32), 0
    for _ in range(40):
        for k in rng.permutation(4):
            own, rate = quality.features(texts[k]), quality.RATE * (1 - step / 160)
            step += 1
            mean = np.mean([vectors[b] for b in own], axis=0)
            z = out @ mean + bias2
            p = np.exp(z) / np.exp(z).sum() - np.eye(2)[labels[k]]
            kinds = sorted(set(own.tolist()))
            grads = {b: rate * np.sqrt(len(kinds)) * (own == b).mean() * (p @ out) for b in kinds}
            for b, g in grads.items():
                vectors[b] -= g
            out, bias2 = out - rate * np.outer(p, mean), bias2 - rate * p
    for t, s in zip(texts, scores, strict=True):
        z = out @ np.mean([vectors[b] for b in quality.features(t)], axis=0) + bias2
        assert s == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-3)


def test_fingerprint_bits_by_hand(spark, tmp_path):
    """All 128 bits through the query, from words and votes counted in plain Python over Spark's own hash."""
    texts = [" ".join(words(n, n)) for n in (3, 5, 9, 200)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(queries.op6_simhash(spark, str(tmp_path)))

    def hashed(values, seed=None):
        args = ", ".join(f"{v}L" if isinstance(v, int) else f"'{v}'" for v in values)
        more = "" if seed is None else f", {seed}"
        return spark.sql(f"select xxhash64({args}{more}) h").first().h

    for k, text in enumerate(texts[:3]):
        own = [hashed([w]) for w in re.findall(r"[^\W_]+", text.lower())]
        terms = [hashed(own[j : j + 5]) for j in range(len(own) - 4)] if len(own) > 5 else [spark.sql(f"select xxhash64(array({', '.join(f'{v}L' for v in own)})) h").first().h]
        want = 0
        for values in (terms, [hashed([t], 0x5851F42D) for t in terms]):
            for b in range(63, -1, -1):
                want = want * 2 + (2 * sum(v >> b & 1 for v in values) > len(values))
        assert got[k]["fingerprint"] == f"{want:032x}"


def test_words_by_the_merge_model_are_whole_encodings():
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.by_word
    texts = ["it's x''s !'s 'sx I'll '' ' a_b '9 ²x ..' 're're don't!!", "\t\n a\r<b> l'été ªº x'd", "`~@#$%^&*()_+{}|:\"<>?[];,./-=", " ".join(words(300, 5)), "ABC Abc9d8", "a b K", ""]
    for text in texts:
        want = b"".join(k.to_bytes(4, "little") for k in encoder.tokenizer.encode(text, add_special_tokens=False).ids)
        assert encoder(text) == want
        encoder.by_word = False
        assert encoder(text) == want
        encoder.by_word = True


def test_buckets_of_ids(spark):
    import bisect

    from pyspark.sql import functions as F

    for n in (1, 2, 3, 16, 17, 300):
        bounds = [3 * k for k in range(1, n + 1)]
        got = spark.range(-3, 3 * n + 9).select("id", simhash._bucket_of(F.col("id"), bounds).alias("k")).collect()
        assert all(r.k == bisect.bisect_right(bounds, r.id) for r in got)
