"""Explainable boosting: against a plain loop, saved and loaded, missing values, pairs, one class, more classes."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from cohortloom.operators import ml
from cohortloom.operators.additive import AdditiveBoost, steps

from .test_estimators import frame


def plain(x, y, bounds, cycles, rate, leaves, width):
    """The same model of two classes by loops over rows."""
    d = x.shape[1]
    cell = np.array([[width - 1 if math.isnan(v) else sum(b < v for b in bounds[j]) for j, v in enumerate(row)] for row in x])
    table, base = np.zeros((d, width)), math.log(y.mean() / (1 - y.mean()))
    for _ in range(cycles):
        for j in range(d):
            p = [1 / (1 + math.exp(-base - sum(table[k][c[k]] for k in range(d)))) for c in cell]
            g, h = np.zeros(width), np.zeros(width)
            for c, t, q in zip(cell[:, j], y, p, strict=True):
                g[c] += t - q
                h[c] += q * (1 - q)
            edges = [0, width - 1]  # the best cuts, one after another
            while len(edges) - 1 < leaves:
                score = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
                best = (1e-12, None)
                for a, b in zip(edges, edges[1:], strict=False):
                    for m in range(a + 1, b):
                        if sum(h[a:m]) > 0 and sum(h[m:b]) > 0 and score(a, m) + score(m, b) - score(a, b) > best[0] + 1e-9:
                            best = (score(a, m) + score(m, b) - score(a, b), m)
                if best[1] is None:
                    break
                edges = sorted([*edges, best[1]])
            for a, b in [*zip(edges, edges[1:], strict=False), (width - 1, width)]:
                for c in range(a, b):
                    table[j][c] += rate * sum(g[a:b]) / (sum(h[a:b]) + 1)
    return [1 / (1 + math.exp(-base - sum(table[k][c[k]] for k in range(d)))) for c in cell]


def test_against_a_loop(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.column_stack([r.normal(size=300), r.integers(0, 3, 300), np.ones(300)]).astype(float)
    x[::17, 0] = math.nan
    y = (r.random(300) < 1 / (1 + np.exp(-2 * np.nan_to_num(x[:, 0], nan=1.5) - x[:, 1] + 1))).astype(int)
    model = AdditiveBoost(cycles=3, bins=8).fit(frame(spark, x, y))
    bounds = model.getOrDefault("bounds")
    assert bounds[1] == [0.0, 1.0, 2.0] and bounds[2] == [1.0]
    want = plain(x, y, bounds, 3, 0.5, 3, 9)
    rows = {v.id: v for v in model.transform(frame(spark, x, y)).collect()}
    assert [rows[i].probability[1] for i in range(300)] == pytest.approx(want, abs=1e-9)
    assert all(rows[i].prediction == float(want[i] > 0.5) for i in range(300) if abs(want[i] - 0.5) > 1e-9)
    PipelineModel([model]).write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(frame(spark, x, y)).collect()
    assert {v.id: v.probability[1] for v in again} == pytest.approx({i: rows[i].probability[1] for i in rows})
    gains = model.featureImportances.toArray()
    assert gains[0] > gains[1] > gains[2] == pytest.approx(0)
    # The shapes add up to the score: intercept and a row a feature.
    shapes = model.shapes(["a", "b", "c"]).collect()
    of = lambda f, v: next(s.score for s in shapes if s.feature == f and (s.above is not None or s.up_to is not None) and (s.above is None or v > s.above) and (s.up_to is None or v <= s.up_to))
    total = model.getOrDefault("intercepts")[0] + of("a", x[1, 0]) + of("b", x[1, 1]) + of("c", 1.0)
    assert rows[1].rawPrediction[1] == pytest.approx(total)


def test_steps():
    assert steps(np.array([4.0, 4, -4, -4]), np.ones(4), 2) == pytest.approx([8 / 3, 8 / 3, -8 / 3, -8 / 3])
    assert steps(np.zeros(3), np.ones(3), 3).tolist() == [0, 0, 0] and steps(np.array([2.0]), np.array([1.0]), 3).tolist() == [1.0]


def test_pairs_find_what_single_features_cannot(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(int)
    df = frame(spark, x, y)
    alone, both = (ml.evaluate(AdditiveBoost(cycles=2, bins=16, pairs=p).fit(df).transform(df))["Accuracy"] for p in (0, 1))
    model = AdditiveBoost(cycles=2, bins=16, pairs=1).fit(df)
    assert model.getOrDefault("pairs") == [[0, 2]] and both > 0.9 > alone
    assert model.featureImportances.toArray().argmin() == 1


def test_more_classes_one_class_and_the_comparison(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2))
    y = (x[:, 0] > 0.4).astype(int) + (x[:, 0] > -0.4).astype(int)
    df = frame(spark, x, y)
    scored = AdditiveBoost(cycles=2).fit(df).transform(df)
    assert ml.evaluate(scored, classes=3)["Accuracy"] > 0.93
    assert all(sum(v.probability) == pytest.approx(1) for v in scored.select("probability").collect())
    assert AdditiveBoost(cycles=1).fit(frame(spark, x, np.zeros(300))).transform(df).filter("prediction <> 0").count() == 0
    c = ml.Classifier()
    c.setup_experiment(df.selectExpr("cast(label > 0 as string) y", "f0", "f1"), "y", folds=2)
    assert "ebm" in c.get_available_models()
    best = c.compare_models(include=["ebm"])[0]
    assert c.leaderboard[0]["Accuracy"] > 0.9 and c.explain_model(best)[0][0] == "f0"
