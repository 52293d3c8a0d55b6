"""Classifiers that MLlib lacks, as estimators: k nearest neighbours and AdaBoost. Both can be saved and loaded."""

from __future__ import annotations

import functools
import math

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .neighbours import BoxTree, box_tree, nearest, numbered


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.save_parts(path)


class _Reader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path).load_parts(path)


class _Saved(MLWritable, MLReadable):
    """A model that writes its params as usual and more beside them."""

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


def _voted(df: DataFrame, votes: str) -> DataFrame:
    """Adds ``rawPrediction`` (the votes), ``probability`` (their shares) and ``prediction`` (the first class of most votes)."""
    total = F.aggregate(votes, F.lit(0.0), lambda t, v: t + v)
    shares = F.transform(votes, lambda v: F.when(total > 0, v / total).otherwise(1.0 / F.size(votes)))
    out = df.withColumns({"rawPrediction": array_to_vector(votes), "probability": array_to_vector(shares), "prediction": (F.array_position(votes, F.array_max(votes)) - 1).cast("double")})
    return out.drop(votes)


class Nearest(Estimator):
    """Votes of the ``k`` nearest rows by standardised features. Labels are 0 to n - 1."""

    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)

    def __init__(self, k: int = 5, features: str = "features", label: str = "label"):
        super().__init__()
        self._setDefault(k=k)
        self.features, self.label = features, label

    def _fit(self, df: DataFrame) -> NearestModel:
        rows = df.select(vector_to_array(self.features).alias("_x"), F.col(self.label).cast("double").alias("_y"))
        d = len(rows.first()._x)
        rows = numbered(rows.select("_y", *[F.col("_x")[j].alias(f"c{j}") for j in range(d)]))
        moments = rows.agg(F.max("_y"), *[f(f"c{j}") for j in range(d) for f in (F.avg, F.stddev_pop)]).first()
        model = NearestModel([float(m) for m in moments[1::2]], [float(s or 0.0) for s in moments[2::2]], int(moments[0]) + 1, self.getOrDefault(self.k), self.features)
        scaled = rows.select("_id", *model.scaled([F.col(f"c{j}") for j in range(d)]))
        model.tree = box_tree(scaled, "_id", model.names(), self.getOrDefault(self.k))
        model.labels = rows.select(F.col("_id").alias("r"), "_y")
        return model


class NearestModel(Model, _Saved):
    means = Param(Params._dummy(), "means", "means of the features", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "deviations of the features", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "name of the vector column", TypeConverters.toString)

    def __init__(self, means=(), deviations=(), classes: int = 2, k: int = 5, features: str = "features"):
        super().__init__()
        self._set(means=list(means), deviations=list(deviations), classes=classes, k=k, features=features)
        self.tree: BoxTree | None = None
        self.labels: DataFrame | None = None

    def names(self) -> list[str]:
        return [f"z{j}" for j in range(len(self.getOrDefault(self.means)))]

    def scaled(self, columns: list) -> list:
        both = zip(columns, self.getOrDefault(self.means), self.getOrDefault(self.deviations), strict=True)
        return [((c - m) / s if s else F.lit(0.0)).alias(f"z{j}") for j, (c, m, s) in enumerate(both)]

    def _transform(self, df: DataFrame) -> DataFrame:
        rows, x = numbered(df), vector_to_array(self.getOrDefault(self.features))
        asked = rows.select("_id", *self.scaled([x[j] for j in range(len(self.names()))]))
        found = nearest(self.tree, asked, "_id", self.names(), self.getOrDefault(self.k)).join(self.labels, "r")
        counts = [F.count_if(F.col("_y") == c).cast("double") for c in range(self.getOrDefault(self.classes))]
        votes = found.groupBy(F.col("q").alias("_id")).agg(F.array(*counts).alias("_votes"))
        out = rows.join(votes, "_id", "left").withColumn("_votes", F.coalesce("_votes", F.array(*[F.lit(0.0)] * len(counts))))
        return _voted(out.drop("_id"), "_votes")

    def save_parts(self, path: str) -> None:
        for name, part in (("leaves", self.tree.leaves), ("kids", self.tree.kids), ("labels", self.labels)):
            part.write.parquet(f"{path}/{name}")

    def load_parts(self, path: str) -> NearestModel:
        from pyspark.sql import SparkSession

        leaves, kids, self.labels = (SparkSession.active().read.parquet(f"{path}/{name}") for name in ("leaves", "kids", "labels"))
        self.tree = BoxTree(leaves, kids, len(self.names()), self.getOrDefault(self.k))
        return self


class AdaBoost(Estimator):
    """Rounds of small trees on reweighted rows (SAMME): rows that a tree gets wrong weigh more in the next. Labels are 0 to n - 1."""

    rounds = Param(Params._dummy(), "rounds", "trees at most", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's weight", TypeConverters.toFloat)

    def __init__(self, rounds: int = 20, maxDepth: int = 1, rate: float = 1.0, seed: int = 42, features: str = "features", label: str = "label"):
        super().__init__()
        self._setDefault(rounds=rounds, maxDepth=maxDepth, rate=rate)
        self.seed, self.features, self.label = seed, features, label

    def _fit(self, df: DataFrame) -> AdaBoostModel:
        rows = settled(df.select(F.col(self.features).alias("features"), F.col(self.label).cast("double").alias("label"), F.lit(1.0).alias("_w")), "boost")
        n = int(rows.agg(F.max("label")).first()[0]) + 1
        made = DecisionTreeClassifier(featuresCol="features", labelCol="label", weightCol="_w", predictionCol="_p", rawPredictionCol="_r", probabilityCol="_q", maxDepth=self.getOrDefault(self.maxDepth), seed=self.seed)
        trees, weights = [], []
        for _ in range(self.getOrDefault(self.rounds)):
            tree = made.fit(rows)
            scored = tree.transform(rows)
            wrong = F.col("_p") != F.col("label")
            missed, total = scored.agg(F.coalesce(F.sum(F.when(wrong, F.col("_w"))), F.lit(0.0)), F.sum("_w")).first()
            error = missed / total
            if error >= 1 - 1 / n:  # no better than chance
                break
            trees.append(tree)
            weights.append(1.0 if error <= 0 else self.getOrDefault(self.rate) * (math.log((1 - error) / error) + math.log(n - 1)))
            if error <= 0:
                break
            # Weights stay at a mean near 1: they are divided by their sum and multiplied by the number of rows' first weight.
            grown = F.when(wrong, F.col("_w") * math.exp(weights[-1])).otherwise(F.col("_w"))
            scale = total / (total - missed + missed * math.exp(weights[-1]))
            rows = settled(scored.select("features", "label", (grown * scale).alias("_w")), "boost")
        if not trees:
            trees, weights = [made.fit(rows)], [1.0]
        gains = sum(t.featureImportances.toArray() * w for t, w in zip(trees, weights, strict=True)) / sum(weights)
        return AdaBoostModel([_as_lists(t._java_obj.rootNode()) for t in trees], weights, n, gains.tolist(), self.features)


def _as_lists(node) -> list:
    """A small tree as nested lists: [class], or [feature, threshold, left, right]."""
    if node.getClass().getSimpleName() == "LeafNode":
        return [node.prediction()]
    split = node.split()
    if split.getClass().getSimpleName() != "ContinuousSplit":
        raise ValueError("nominal features are not supported")
    return [split.featureIndex(), split.threshold(), _as_lists(node.leftChild()), _as_lists(node.rightChild())]


class AdaBoostModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Votes are column expressions of the features; no tree is called row by row."""

    trees = Param(Params._dummy(), "trees", "trees as nested lists")
    weights = Param(Params._dummy(), "weights", "weight of each tree", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    gains = Param(Params._dummy(), "gains", "importance of each feature", TypeConverters.toListFloat)
    features = Param(Params._dummy(), "features", "name of the vector column", TypeConverters.toString)

    def __init__(self, trees=(), weights=(), classes: int = 2, gains=(), features: str = "features"):
        super().__init__()
        self._set(trees=list(trees), weights=list(weights), classes=classes, gains=list(gains), features=features)

    @property
    def featureImportances(self):
        from pyspark.ml.linalg import DenseVector

        return DenseVector(self.getOrDefault(self.gains))

    def _transform(self, df: DataFrame) -> DataFrame:
        def vote(tree: list, label: int, weight: float):
            if len(tree) == 1:
                return F.lit(weight if tree[0] == label else 0.0)
            feature, threshold, left, right = tree
            return F.when(F.col("_x")[feature] <= threshold, vote(left, label, weight)).otherwise(vote(right, label, weight))

        own = list(zip(self.getOrDefault(self.trees), self.getOrDefault(self.weights), strict=True))
        votes = [functools.reduce(lambda a, b: a + b, [vote(t, c, float(w)) for t, w in own]) for c in range(self.getOrDefault(self.classes))]
        return _voted(df.withColumn("_x", vector_to_array(self.getOrDefault(self.features))).withColumn("_votes", F.array(*votes)).drop("_x"), "_votes")
