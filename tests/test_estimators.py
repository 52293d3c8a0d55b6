"""k nearest neighbours and AdaBoost as estimators: against plain loops, in the comparison, saved and loaded."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from cohortloom.operators import ml
from cohortloom.operators.estimators import AdaBoost, Nearest


def frame(spark, x, y):
    df = spark.createDataFrame([(k, float(t), *map(float, v)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, label double, " + ", ".join(f"f{j} double" for j in range(x.shape[1])))
    return VectorAssembler(inputCols=[f"f{j}" for j in range(x.shape[1])], outputCol="features", handleInvalid="keep").transform(df)


def saved(model, path):
    PipelineModel([model]).write().save(path)
    return PipelineModel.load(path)


def test_nearest(spark, tmp_path):
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=(120, 2)), np.ones(120)])
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)).astype(int)
    model = Nearest(k=4).fit(frame(spark, x, y))
    fresh = np.column_stack([r.normal(size=(30, 2)), np.full(30, 7.0)])
    got = {v.id: (v.prediction, v.probability.toArray()) for v in model.transform(frame(spark, fresh, np.zeros(30))).collect()}
    again = {v.id: v.prediction for v in saved(model, f"{tmp_path}/m").transform(frame(spark, fresh, np.zeros(30))).collect()}
    z, q = ((v[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0) for v in (x, fresh))
    for i in range(30):
        near = [j for _, j in sorted((((z[j] - q[i]) ** 2).sum(), j) for j in range(120))[:4]]
        votes = np.bincount(y[near], minlength=3)
        assert got[i][0] == votes.argmax() == again[i] and got[i][1] == pytest.approx(votes / 4)


def plain_boost(x, y, rounds, n):
    """SAMME with stumps on features of 0 and 1: each leaf says its weightiest class, the split is the one of least weighted impurity."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for j in range(x.shape[1]):
            sides = [np.bincount(y[x[:, j] == s], w[x[:, j] == s], n) for s in (0, 1)]
            if min(s.sum() for s in sides) == 0:
                continue
            gini = sum(s.sum() - (s**2).sum() / s.sum() for s in sides)
            if best is None or gini < best[0] - 1e-9:
                best = (gini, j, [s.argmax() for s in sides])
        said = np.where(x[:, best[1]] == 1, best[2][1], best[2][0])
        error = w[said != y].sum() / w.sum()
        if error >= 1 - 1 / n:
            break
        a = math.log((1 - error) / error) + math.log(n - 1)
        out.append((a, best[1], best[2]))
        w = w * np.exp(a * (said != y))
    return out


def test_boosting(spark, tmp_path):
    r = np.random.default_rng(6)
    x = r.integers(0, 2, (300, 4))
    y = np.where(r.random(300) < 0.2, r.integers(0, 2, 300), (x[:, :3].sum(1) > 1).astype(int))
    model = AdaBoost(rounds=5).fit(frame(spark, x, y))
    want = plain_boost(x, y, 5, 2)
    assert model.getOrDefault("weights") == pytest.approx([a for a, *_ in want])
    votes = np.zeros((300, 2))
    for a, j, said in want:
        votes[np.arange(300), np.where(x[:, j] == 1, said[1], said[0])] += a
    got = {v.id: (v.prediction, v.probability.toArray()) for v in model.transform(frame(spark, x, y)).collect()}
    again = {v.id: v.prediction for v in saved(model, f"{tmp_path}/m").transform(frame(spark, x, y)).collect()}
    for i in range(300):
        assert got[i][1] == pytest.approx(votes[i] / votes[i].sum()) and got[i][0] == votes[i].argmax() == again[i]
    assert model.featureImportances.toArray().argmax() < 3
    sure = AdaBoost().fit(frame(spark, x, x[:, 0]))  # one tree is right everywhere
    assert len(sure.getOrDefault('trees')) == 1 and AdaBoost().fit(frame(spark, x, np.zeros(300))).transform(frame(spark, x, y)).filter("prediction <> 0").count() == 0


def test_in_the_comparison(spark):
    r = np.random.default_rng(7)
    rows = [("p" if a + e > 0 else "n", float(a), float(e)) for a, e in zip(r.normal(0, 1, 150), r.normal(0, 0.3, 150), strict=True)]
    c = ml.Classifier()
    c.setup_experiment(spark.createDataFrame(rows, "y string, a double, b double"), "y", folds=2)
    assert {"knn", "ada"} <= set(c.get_available_models())
    c.compare_models(include=["knn", "ada"])
    assert {x["model"] for x in c.leaderboard} == {"knn", "ada"} and all(x["Accuracy"] > 0.7 for x in c.leaderboard)
