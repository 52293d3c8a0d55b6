"""Shapley values against all coalitions, on a tree, a forest, boosting and a regression."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from cohortloom.operators import select, shap


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(250, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float) + (x[:, 0] > 1.2)
    df = spark.createDataFrame([(float(t), *map(float, v)) for t, v in zip(y, x, strict=True)], "label double, a double, b double, c double, d double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).cache()


def value(node, x, coalition, value_of):
    """A row's output when only the coalition's features are known."""
    if node.getClass().getSimpleName() == "LeafNode":
        return value_of(node)
    f, sides = node.split().featureIndex(), (node.leftChild(), node.rightChild())
    if f in coalition:
        return value(sides[0] if x[f] <= node.split().threshold() else sides[1], x, coalition, value_of)
    n = node.impurityStats().count()
    return sum(value(s, x, coalition, value_of) * s.impurityStats().count() / n for s in sides)


def by_coalitions(tree, x, value_of):
    out = []
    for i in range(len(x)):
        rest, total = [j for j in range(len(x)) if j != i], 0
        for k in range(len(x)):
            for s in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(len(x) - 1 - k) / math.factorial(len(x))
                total = total + weight * (value(tree, x, {*s, i}, value_of) - value(tree, x, set(s), value_of))
        out.append(total)
    return np.array(out).T


def test_a_tree_by_all_coalitions(rows):
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(rows)

    def share(node):
        s = np.array([node.impurityStats().stats()[c] for c in range(3)])
        return s / s.sum()

    for r in shap.shap_values(model, rows.limit(12)).collect():
        assert np.allclose(r.shap, by_coalitions(model._java_obj.rootNode(), r.features.toArray(), share))


@pytest.mark.parametrize("kind", ["forest", "boosting", "regression"])
def test_values_add_up(rows, kind):
    if kind == "boosting":
        rows = rows.selectExpr("features", "if(label > 0, 1D, 0D) as label")
    model = {"forest": RandomForestClassifier(numTrees=8, maxDepth=5, seed=1), "boosting": GBTClassifier(maxIter=4, maxDepth=3, seed=1), "regression": RandomForestRegressor(numTrees=6, maxDepth=4, seed=1)}[kind].fit(rows)
    base = shap.base_value(shap.tree_leaves(model))
    for r in shap.shap_values(model, model.transform(rows.limit(60))).collect():
        output = {"forest": lambda r: r.probability.toArray(), "boosting": lambda r: [r.rawPrediction[1]], "regression": lambda r: [r.prediction]}[kind](r)
        assert np.allclose(np.sum(r.shap, 1) + base, output)


def test_selection(rows):
    s = select.FeatureSelector("shap", param=2).fit(rows.drop("features"), list("abcd"), "label")
    assert len(s.selected) == 2 and "a" in s.selected and "d" not in s.selected
    assert shap.shap_values(DecisionTreeClassifier(maxDepth=2).fit(rows), rows.limit(0)).count() == 0
