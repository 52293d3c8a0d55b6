import pytest

from cohortloom.llm import decontam, langid, packing, quality
from cohortloom.llm.common import cut, free_shuffles
from cohortloom.operators import stats

from .helpers import frame, words


def test_clean_up_is_switched_on(spark):
    """Also where the session has not set it: then a read with a default gives the default, not what Spark knows."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.unset(key)
    free_shuffles(spark)
    assert spark.conf.get(key) == "true"


def test_clean_up_ends_with_the_write(spark):
    """A session whose user iterates over queries of their own has its own setting back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for value in ("false", None):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        before = spark.conf.get(key)
        cut(spark.range(9).distinct(), "nine")
        assert spark.conf.get(key) == before == "false"


@pytest.mark.parametrize("clean_up", ["true", "false"])
def test_no_iterator_stands_on_a_shuffle(spark, monkeypatch, clean_up):
    """Shuffle files may go when the iterator stands, before its tasks have read them."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    kind = type(spark.range(1))
    real = kind.toLocalIterator

    def watched(df, *args, **kwargs):
        plan = df._jdf.queryExecution().toString()
        assert "Exchange" not in plan, plan
        seen.append(df)
        return real(df, *args, **kwargs)

    texts = [" ".join(words(60, k)) for k in range(12)] + ["", None]
    docs, items = frame(spark, texts), spark.createDataFrame([(1, texts[3]), (2, "w1 w2")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    times = spark.createDataFrame([(float(k % 5), k % 2, "ab"[k % 2]) for k in range(30)], "t double, e int, g string")
    monkeypatch.setattr(kind, "toLocalIterator", watched)
    spark.conf.set(key, clean_up)
    try:
        assert {r.doc_id for r in decontam.contamination(docs, items).filter("n_hit > 0").collect()} >= {3}
        assert packing.pack(docs).count() == len(texts)
        assert langid.fit(docs)
        quality.fit(docs, labels)
        assert list(stats.km_grid(times, "t", "e", "g")) == ["b"]
    finally:
        spark.conf.unset(key)
    assert len(seen) > 3
