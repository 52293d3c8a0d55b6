import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import ml, stats


def _rows(spark, n=3000):
    r = np.random.default_rng(7)
    return spark.createDataFrame([(None if k % 97 == 0 else "pqr"[int(c)], float(v)) for k, (c, v) in enumerate(zip(r.integers(0, 3, n), r.integers(0, 400, n), strict=True))], "y string, a double")


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 1.0])
def test_split_by_rank_in_cells(spark, share):
    """The same rows as by ranks of all of them, which only the last cell of each class needs."""
    df = _rows(spark)
    own = F.xxhash64("y", "a", F.lit(42))
    ranked = df.withColumns({"h": own, "c": F.pmod(own, F.lit(64))}).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("c", "h"))).withColumn("all", F.count("*").over(Window.partitionBy("y")))
    want = sorted(map(str, ranked.filter(F.col("r") <= F.round(F.col("all") * share)).select("y", "a").collect()))
    train, test = ml.stratified_split(df, "y", share)
    assert sorted(map(str, test.collect())) == want
    assert sorted(map(str, train.union(test).collect())) == sorted(map(str, df.collect()))
    plan = test._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_folds_are_made_once(spark, monkeypatch):
    made = []
    plain = ml.folded
    monkeypatch.setattr(ml, "folded", lambda *a, **k: made.append(1) or plain(*a, **k))
    c = ml.Classifier()
    c.setup_experiment(_rows(spark), "y", folds=2)
    c.compare_models(include=["nb", "dt"])
    assert len(c.leaderboard) == 2 and len(made) == 1


def test_auc_of_counted_rows(spark):
    df = spark.createDataFrame([(float(k % 7), int(k % 3 == 0)) for k in range(90)], "s double, g int")
    counted = df.groupBy("s", "g").agg(F.count("*").alias("n"))
    assert stats.rank_auc(counted, "s", "g", "n") == pytest.approx(stats.rank_auc(df, "s", "g"), abs=0)
