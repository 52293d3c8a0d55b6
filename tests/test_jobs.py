"""The jobs: against their SQL, rerun, on growing input, on odd rows."""

import datetime as dt
import json
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

from jobs import queries, text_features, visit_changes

DAY = dt.datetime(2024, 1, 1, 9)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def near(got, want):
    key = lambda r: [repr(round(x, 2)) if isinstance(x, float) else repr(x) for x in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want) and got
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    near([tuple(r[n] for n in names) for r in df.collect()], [tuple(r) for r in cur.fetchall()])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_features_on_odd_rows(spark, tmp_path):
    docs = [(1, "Ab 12.\nx", "en", "s", 9), (1, "Ab 12.\nx", "en", "s", 9), (2, None, "en", "t", 9), (3, "", "en", None, 9), (None, "a b c", "", "s", 9), (None, None, None, "s", 9), (4, "x " * 200_000, "en", "s", 9), (5, "same", "fr", "s", 9), (6, "same", "fr", "s", 9), (7, None, "xx", "s", 9)]
    labels = [(1, 0, 1), (1, 1, 1), (None, 1, 0), (99, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, cohort int").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/l")
    run = lambda: text_features.run(spark, f"{tmp_path}/d", f"{tmp_path}/l", f"{tmp_path}/out")
    first = rows(run())
    assert rows(run()) == first and len(first) == len(docs)
    out = {(r.doc_id, r.lang): r for r in run().collect()}
    assert out[1, "en"].cohort == 1 and out[2, "en"].cohort is None and {r.lang for r in out.values()} == {"en", "und", "fr", "xx"}
    assert out[5, "fr"].z_n_chars == 0 and out[7, "xx"].z_n_chars is None and out[4, "en"].n_beyond > 0
    assert {r.cohort for r in out.values() if r.doc_id is None} == {None} and out[3, "en"].split == "train"
    spark.createDataFrame(docs[7:9], "doc_id long, text string, lang string, source string, cohort int").write.mode("overwrite").parquet(f"{tmp_path}/d")
    assert {r.lang for r in run().collect()} == {"fr"}  # languages that are gone leave nothing behind
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{tmp_path}/d")
    assert run().count() == 0


def test_text_features_go_through_a_text_once(spark):
    """Counts of all kinds come from one pass, also of characters outside ASCII; no pattern is matched against texts."""
    texts = ["Ab 12.\nx", "", " \t\r\n", "a\x0bb\x0cc\x1cd\x85e\xa0f\u2003g", "É٣\U0001f600 É٣\U0001f600 !/:@[`{~ x", "\x00 a a A\n\n", None]
    df = text_features.measure(spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, _digits string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan.lower()
    assert df.columns == ["doc_id", "_digits", "n_chars", *[f for f in text_features.FEATURES if f != "n_chars"]]
    ratio = lambda a, b: a / b if b else None
    for r in df.collect():
        t = texts[r.doc_id]
        if t is None:
            want = [None] * len(text_features.FEATURES)
        else:
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            kinds = [ratio(len(re.findall(k, t)), len(t)) for k in ("[0-9]", "[A-Z]", r"[!-/:-@\[-`{-~]")]
            want = [len(t), len(words), t.count("\n") + 1, ratio(sum(map(len, words)), len(words)), ratio(len(set(words)), len(words)), *kinds]
        assert [r[f] for f in text_features.FEATURES] == want and r._digits == "kept"


def write_events(spark, path, events):
    spark.createDataFrame(events, EVENTS).coalesce(1).write.mode("append").parquet(path)


def expected(spark, events):
    """All visits from all events at once."""
    df = spark.createDataFrame(events, EVENTS)
    return rows(visit_changes.visits_of(visit_changes.visit_sums(df, 4)))


def test_visits_on_growing_input(spark, tmp_path):
    events, path, out, mark = [], f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    run = lambda: rows(visit_changes.run(spark, path, out, mark, buckets=4, files_per_batch=1))
    at = lambda n: DAY + dt.timedelta(days=n)
    parts = [
        [(1, at(3), 1, "gait", 2.0, None), (2, at(3), 1, "gait", 4.0, None), (3, at(5), 1, "gait", 6.0, None), (4, at(3), 2, "tremor", 0.0, "x"), (5, at(9), 2, "tremor", 5.0, None)],
        [(6, at(1), 1, "gait", 1.0, None), (7, None, 1, "gait", 1.0, None), (8, at(1), None, "gait", 1.0, None), (9, at(2), 3, None, None, None), (9, at(4), 3, None, float("nan"), None)],  # before the baseline; no visit; no value
        [(10, at(4), 3, None, 7.0, None), (10, at(4), 3, None, 7.0, None)] + [(100 + k, at(k % 50), 5, "gait", float(k % 7), None) for k in range(400)],
    ]
    for part in parts:
        write_events(spark, path, part)
        events += part
        got = run()
        assert got == expected(spark, events)
        assert run() == got  # nothing new: nothing changes
    write_events(spark, path, [(200, at(1), 6, "gait", 1.0, None)])
    write_events(spark, path, [(201, at(2), 6, "gait", 3.0, None)])  # two files: two batches of one run
    events += [(200, at(1), 6, "gait", 1.0, None), (201, at(2), 6, "gait", 3.0, None)]
    assert run() == expected(spark, events)
    by = {r.measure: r for r in visit_changes.visits_of(visit_changes.visit_sums(spark.createDataFrame(events, EVENTS), 4)).filter("subject = 1 and visit = '2024-01-06'").collect()}
    assert (by["gait"].visit_no, by["gait"].baseline, by["gait"].change, by["gait"].pct_change) == (3, 1.0, 5.0, 500.0)


def test_a_batch_taken_twice_counts_once(spark, tmp_path):
    events = [(1, DAY, 1, "gait", 2.0, None), (2, DAY, 2, "gait", 4.0, None)]
    batch = spark.createDataFrame(events, EVENTS)
    for _ in range(2):
        visit_changes.take_batch(batch, 0, f"{tmp_path}/out", f"{tmp_path}/mark", 4)
    visit_changes.take_batch(batch.limit(0), 1, f"{tmp_path}/out", f"{tmp_path}/mark", 4)
    assert rows(spark.read.schema(visit_changes.VISITS).parquet(f"{tmp_path}/out")) == expected(spark, events)


def test_settings_stay(spark, sf):
    before = dict(spark.conf.getAll)
    queries.queries()["job2_visit_changes"](spark, sf).count()
    assert dict(spark.conf.getAll) == before


@pytest.mark.parametrize("module", ["text_features", "visit_changes"])
def test_command_line(spark, sf, tmp_path, module):
    """The module with its own session, in another process, with paths in place of the config's."""
    tables = {"text_features": {"documents": f"{sf}/documents.parquet", "labels": f"{sf}/labels.parquet"}, "visit_changes": {"events": f"{sf}/events.parque[t]", "checkpoint": f"{tmp_path}/mark"}}[module]
    config = json.load(open(f"jobs/{module}.json"))
    assert set(tables) | {"output"} <= set(config)
    args = [x for k, v in (tables | {"output": f"{tmp_path}/out"}).items() for x in (f"--{k}", v)]
    done = subprocess.run([sys.executable, "-m", f"jobs.{module}", *args], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "wrote" in done.stderr and spark.read.parquet(f"{tmp_path}/out").count() > 0
    shutil.rmtree(f"{tmp_path}/out")
