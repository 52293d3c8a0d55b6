"""SentencePiece encoding against the library itself, and the parts of the method against plain merging."""

import hashlib
import random

import pytest

from cohortloom.llm import pieces, queries

from .helpers import frame


@pytest.fixture(scope="module")
def encoder():
    return pieces.encoder_of(pieces.default_model())


def texts(encoder):
    r = random.Random(3)
    entries = sorted(encoder.ids)
    for _ in range(1500):
        yield "".join(r.choice(entries) for _ in range(r.randrange(1, 12)))
    for _ in range(1500):
        yield "".join(r.choice("abcest ▁ n\t1é.") for _ in range(r.randrange(60)))
    for _ in range(1500):
        yield "".join(chr(r.choice([32, r.randrange(0, 128), r.randrange(0x80, 0x3000), r.randrange(0x1F300, 0x1F700), r.randrange(0xE000, 0xF000)])) for _ in range(r.randrange(30)))
    for _ in range(500):
        yield r.choice("ax= -e─") * r.randrange(1, 200) + r.choice("ab ")
    yield from ("", " ", "  ", "\x00", "<s></s><unk><0x41>", "á ﬁ 　x", "﻿a", "▁", "招超ła排──▁regions▁valuedauthŒ")


def test_equals_the_library(encoder):
    for text in texts(encoder):
        ids = encoder(text)
        assert ids == encoder.model.encode(text), text
        assert encoder.decode(ids) == encoder.model.decode(ids)


def test_tokens_equal_merging(encoder):
    """Backtracking over whole strings, without chunks, against merging them."""
    r = random.Random(4)
    entries = [p for p in sorted(encoder.ids) if p.isascii()]
    for _ in range(800):
        text = "".join(r.choice(entries) for _ in range(r.randrange(1, 6)))[:40]
        assert encoder.tokens(text) == encoder.merge(text)


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 300_000, "ab" * 300_000, "x y " * 200_000, "中" * 300_000, "\U0010ffff" * 100_000], ids=["byte", "spaces", "pair", "words", "cjk", "unknown"])
def test_very_long_texts(encoder, text):
    ids = encoder(text)
    assert ids == encoder.model.encode(text) and encoder.decode(ids) == encoder.model.decode(ids)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.PieceEncoder(str(tmp_path / "none.model"))


def test_query_and_odd_rows(spark, sf, encoder, tmp_path):
    odd = [None, "", " ", "a  b", "same", "same", "é▁x", "x" * 5000]
    frame(spark, odd, [1, 2, 3, None, 5, 5, 7, 8]).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (sf, str(tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = []
        for d in docs:
            ids = encoder.model.encode(d.text or "")
            want.append((d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(encoder.model.decode(ids) if ids else "")))
        got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op12_pieces(spark, folder).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(docs)


def test_columns_and_empty_tables(spark):
    df = frame(spark, ["a b", None])
    out = pieces.decode(pieces.encode(df, ids_col="id"), ids_col="id", text_col="text")
    assert sorted(out.columns) == sorted(df.columns)
    assert [(r.text, r.lang, len(r.id)) for r in out.orderBy("doc_id").collect()] == [("a b", "en", 2), ("", "en", 0)]
    nulls = spark.createDataFrame([(1, None)], "k int, ids array<int>")
    assert pieces.decode(nulls).collect()[0].decoded == ""
    assert pieces.encode(df.limit(0)).count() == 0
