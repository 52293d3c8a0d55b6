"""Shapley values of MLlib's trees and forests, exact for each row, by the path-dependent game: a feature that is not in the coalition sends a row down
both branches, weighted by the training rows that went there.

A leaf with d different features on its path is a product game: its value for a coalition is the leaf's value times, for each feature, 1
or 0 (whether the row meets the path's conditions on it) if the feature takes part, else the share of training rows that met them. A
feature's Shapley value in such a game follows from the other features' terms multiplied out by the size of the coalition, so the work is a few
products a leaf and feature, for whole batches of rows. Trees come to the driver as lists of leaves, rows stay in their tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tree import _DecisionTreeModel, _TreeEnsembleModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass
class Leaf:
    """value: a number for each output. conditions: by feature its lower and upper bound (low < x <= high) and the share of training rows."""

    value: np.ndarray
    conditions: dict[int, tuple[float, float, float]]


def _leaves(node, value_of, conditions: dict | None = None) -> list[Leaf]:
    conditions = conditions or {}
    if node.getClass().getSimpleName() == "LeafNode":
        return [Leaf(value_of(node), conditions)]
    split = node.split()
    if split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("nominal features are not supported")
    feature, threshold = split.featureIndex(), split.threshold()
    low, high, share = conditions.get(feature, (-math.inf, math.inf, 1.0))
    here, out = node.impurityStats().count(), []
    for child, bounds in ((node.leftChild(), (low, min(high, threshold))), (node.rightChild(), (max(low, threshold), high))):
        out += _leaves(child, value_of, conditions | {feature: (*bounds, share * child.impurityStats().count() / here)})
    return out


def tree_leaves(model) -> list[Leaf]:
    """All leaves of a tree, forest or boosted model. The outputs are class probabilities; of a regression, and of boosting, whose score is
    explained, there is one. Other models raise TypeError."""
    if not isinstance(model, (_DecisionTreeModel, _TreeEnsembleModel)):
        raise TypeError(f"{type(model).__name__} is not a model of trees")
    classes = getattr(model, "numClasses", 0) if "Classification" in type(model).__name__ else 0
    boosted = type(model).__name__.startswith("GBT")

    def value_of(node):
        if boosted or not classes:
            return np.array([node.prediction()])
        stats = np.array([node.impurityStats().stats()[c] for c in range(classes)])
        return stats / max(stats.sum(), 1e-300)

    trees = model.trees if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if boosted else [1 / len(trees)] * len(trees)
    return [Leaf(leaf.value * w, leaf.conditions) for t, w in zip(trees, weights, strict=True) for leaf in _leaves(t._java_obj.rootNode(), value_of)]


def base_value(leaves: list[Leaf]) -> np.ndarray:
    """The output for no feature: leaves by their shares of training rows."""
    return sum(leaf.value * math.prod(share for *_, share in leaf.conditions.values()) for leaf in leaves)


def shapley(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, outputs, features)"""
    out = np.zeros((len(x), len(leaves[0].value), x.shape[1]))
    for leaf in leaves:
        features, d = list(leaf.conditions), len(leaf.conditions)
        if not d:
            continue
        met = np.stack([(low < x[:, f]) & (x[:, f] <= high) for f, (low, high, _) in leaf.conditions.items()], 1).astype(float)
        shares = np.array([share for *_, share in leaf.conditions.values()])
        size_weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for i, feature in enumerate(features):
            by_size = np.zeros((len(x), d))  # sums over coalitions of the other features, by their size
            by_size[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    by_size[:, 1:] = by_size[:, 1:] * shares[j] + by_size[:, :-1] * met[:, j, None]
                    by_size[:, 0] *= shares[j]
            gain = (met[:, i] - shares[i]) * (by_size @ size_weight)
            out[:, :, feature] += gain[:, None] * leaf.value
    return out


def shap_values(model, df: DataFrame, features: str = "features", name: str = "shap") -> DataFrame:
    """``df`` with ``name``: of each output an array with a value for each feature. They add up to the output less ``base_value``."""
    leaves = tree_leaves(model)

    @pandas_udf("array<array<double>>")
    def explain(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        return pd.Series([v.tolist() for v in shapley(leaves, np.stack(rows.to_list()))])

    return df.withColumn(name, explain(vector_to_array(features)))


def mean_effects(model, df: DataFrame, features: str = "features") -> list[float]:
    """Of each feature the mean absolute value over all rows and outputs."""
    cells = shap_values(model, df.select(features), features).select(F.explode("shap").alias("own")).select(F.posexplode("own").alias("at", "v"))
    found = {r["at"]: r.m for r in cells.groupBy("at").agg(F.avg(F.abs("v")).alias("m")).collect()}  # a row a feature
    return [found.get(j, 0.0) for j in range(model.numFeatures)]
