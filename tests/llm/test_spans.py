"""Secrets and personal data against the plain patterns."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import pii, queries, secrets

from .helpers import frame, rows

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def plain_pii(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


SECRET_PARTS = ["token", "PASSWORD", "ſecret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123", "0123456789abcdef", "deadbeef", "é", "x", "-", "\n"]
PII_PARTS = ["a.b", "@", "mail", ".com", ".", "-", " ", "4111111111111111", "4111 1111", "1.2.3.4", "256", "0001", "+1", "(5)", "555-0100", "é", "1", "22", "+", "%", "_", "٣"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert [x for x in secrets.find_secrets(text) if x[0] in secrets.BASE_KINDS] == plain_secrets(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PII_PARTS), max_size=14).map("".join))
def test_pii_base_spans(text):
    assert [x for x in pii.find_pii(text) if x[0] in pii.BASE_KINDS] == plain_pii(text)


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 " * 100_000, "token=" * 50_000, "abc0" * 80_000):
        pii.find_pii(text)
        secrets.find_secrets(text)


def test_method_spans():
    assert [x[0] for x in pii.find_pii("account GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert not pii.find_pii("account GB83 WEST 1234 5698 7654 32 now")
    assert [x[0] for x in secrets.find_secrets("-----BEGIN RSA PRIVATE KEY-----")] == ["private_key"]


def test_context_words():
    """Whole words on both sides count; parts of words, also those that the window's edge leaves, do not."""
    told = lambda text, kind, span: pii.score(text, kind, text.index(span), text.index(span) + len(span)) > pii.PRIOR[kind]
    assert told("my bank account GB82", "iban", "GB82") and told("+49 30 1234567 (Telefon)", "phone", "+49 30 1234567")
    assert not told("zzzzzz GB82", "iban", "GB82")
    assert not told("the trip to 1.2.3.4", "ip", "1.2.3.4") and not told("hotel +49 30 1234567", "phone", "+49 30 1234567")
    assert not told("server " + "x" * 50 + " 1.2.3.4", "ip", "1.2.3.4")
    edge = "tr" + "ip" + " " * (pii.WINDOW - 2) + "1.2.3.4"
    assert not told(edge, "ip", "1.2.3.4") and told(edge[2:], "ip", "1.2.3.4")
    assert not told("1.2.3.4" + " " * (pii.WINDOW - 2) + "ipx", "ip", "1.2.3.4")


def corpus():
    r = random.Random(5)
    texts = ["".join(r.choice(SECRET_PARTS + PII_PARTS) for _ in range(r.randrange(40))) for _ in range(60)]
    return [None, "", *texts, texts[0], texts[1], texts[1], "token: abcdefgh" * 2000]


@pytest.mark.parametrize("kind", ["secrets", "pii"])
def test_queries_match_plain(spark, tmp_path, kind):
    texts = corpus()
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows((queries.op1_secret_scan if kind == "secrets" else queries.op3_pii)(spark, str(tmp_path)))
    plain = plain_secrets if kind == "secrets" else plain_pii
    for i, text in enumerate(texts):
        spans = plain(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        for name in ("assign", "access", "hex") if kind == "secrets" else ("email", "ip", "card", "phone"):
            assert got[i][f"n_{name}"] == sum(x[0] == name for x in spans)


def test_ledger_scans_only_unseen(spark):
    docs = frame(spark, ["token=abcdef123", "clean", None, "token=abcdef123"])
    _, ledger = secrets.scan_versions(docs)
    assert ledger.count() == 3
    found, new = secrets.scan_versions(frame(spark, ["token=abcdef123", "secret: zzzzzz9"]), ledger)
    assert new.count() == 1 and sorted(len(r.findings) for r in found.collect()) == [1, 1]
    _, again = secrets.scan_versions(docs, ledger, rule_version="next")
    assert again.count() == 3


def test_ledger_is_kept_from_run_to_run(spark, tmp_path):
    path, texts = f"{tmp_path}/ledger", corpus()
    first, second = frame(spark, texts[:40]), frame(spark, texts)
    assert secrets.read_ledger(spark, path) is None
    secrets.scan_with_ledger(first, path)
    known = {t or "" for t in texts[:40]}
    ledger = secrets.read_ledger(spark, path)
    assert ledger.count() == len(known)
    _, new = secrets.scan_versions(second, ledger)
    assert new.count() == len({t or "" for t in texts} - known)
    got = {r.doc_id: [(x["kind"], x["start"], x["end"]) for x in r.findings] for r in secrets.scan_with_ledger(second, path).collect()}
    assert got == {k: secrets.find_secrets(t or "") for k, t in enumerate(texts)}
    assert secrets.read_ledger(spark, path).count() == len({t or "" for t in texts})
    assert secrets.scan_versions(second, secrets.read_ledger(spark, path))[1].isEmpty()


def test_null_ids_and_empty_tables(spark):
    docs = frame(spark, ["token=abcdef123", "token=abcdef123", "x"], [None, None, 1])
    assert sorted(len(r.findings) for r in secrets.scan_versions(docs)[0].collect()) == [0, 1, 1]
    empty = docs.limit(0)
    assert secrets.scan_versions(empty)[0].count() == 0 and pii.detect(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_redact(spark):
    docs = frame(spark, ["a token=abcdef123 b", "clean", None])
    out = rows(secrets.redact(docs))
    assert out[0]["text"] == "a [secret] b" and out[0]["n_chars"] == 12 and out[1]["text"] == "clean" and out[2]["text"] is None
    assert secrets.redact(docs).columns == docs.columns


def test_redact_where_texts_share_an_id(spark):
    texts = ["token=abcdef123 one", "two secret: zzzzzz9", "clean text of some length", None, "token=abcdef123 one"]
    want = [("[secret] one", 12), ("two [secret]", 12), (texts[2], len(texts[2])), (None, None), ("[secret] one", 12)]
    for i in (7, None):
        got = secrets.redact(frame(spark, texts, [i] * len(texts))).collect()
        assert sorted((r.text, r.n_chars) for r in got if r.text) == sorted(w for w in want if w[0]) and len(got) == len(want)


def test_redact_with_clashing_names(spark):
    docs = frame(spark, ["a token=abcdef123 b", "clean"])
    for n in ("_id", "findings", "row", "own_id", "own_blob", "hit_id", "blob", "_blob", "a.b"):
        docs = docs.withColumn(n, docs.doc_id)
    out = rows(secrets.redact(docs))
    assert out[0]["text"] == "a [secret] b" and out[1]["text"] == "clean" and secrets.redact(docs).columns == docs.columns
    assert all(out[k][n] == k for k in out for n in ("_id", "findings", "row", "blob", "a.b"))
