"""Linear and quadratic discriminant classifiers: class moments from MLlib, scores as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Discriminant(Estimator):
    """Gaussian classes with a shared covariance (linear) or one each (quadratic).

    Labels are 0 to k - 1. ``regParam`` is the share of the covariance that is replaced by its diagonal; directions
    without variance do not count. Classes without rows are never predicted.
    """

    regParam = Param(Params._dummy(), "regParam", "share of the diagonal in the covariance", TypeConverters.toFloat)

    def __init__(self, quadratic: bool = False, regParam: float = 0.0, features: str = "features", label: str = "label"):
        super().__init__()
        self._setDefault(regParam=regParam)
        self.quadratic, self.features, self.label = quadratic, features, label

    def _fit(self, df: DataFrame) -> DiscriminantModel:
        own = df.select(F.col(self.features).alias("x"), F.col(self.label).cast("int").alias("y"))
        moments = own.groupBy("y").agg(Summarizer.metrics("count", "mean", "std").summary(F.col("x")).alias("s")).orderBy("y").collect()
        n, d = sum(r.s["count"] for r in moments), len(moments[0].s["mean"])
        found, pooled = [], np.zeros((d, d))
        for r in moments:
            count, std = r.s["count"], r.s["std"].toArray()
            cov = np.zeros((d, d))
            if count > 1:
                corr = np.nan_to_num(Correlation.corr(own.filter(F.col("y") == r.y), "x").first()[0].toArray())
                np.fill_diagonal(corr, 1.0)
                cov = corr * np.outer(std, std)
            pooled += cov * (count - 1)
            found.append((r.y, count, r.s["mean"].toArray(), cov))
        pooled /= max(1, n - len(found))
        state = []
        for y, count, mean, cov in found:
            cov = cov if self.quadratic else pooled
            share = self.getOrDefault(self.regParam)
            value, vector = np.linalg.eigh((1 - share) * cov + share * np.diag(np.diag(cov)))
            kept = value > 1e-12 * max(1e-300, value.max())
            turn = (vector[:, kept] / np.sqrt(value[kept])).T  # the squared length of turn @ (x - mean) is the distance
            state.append([int(y), float(np.log(count / n) - 0.5 * np.log(value[kept]).sum()), turn.tolist(), (turn @ mean).tolist()])
        return DiscriminantModel(state, self.features)


class DiscriminantModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """Adds ``rawPrediction`` (log densities), ``probability`` and ``prediction``."""

    state = Param(Params._dummy(), "state", "class, constant, whitening matrix and whitened mean of each class")
    features = Param(Params._dummy(), "features", "name of the vector column")

    def __init__(self, state: list | None = None, features: str = "features"):
        super().__init__()
        self._set(state=state or [], features=features)

    def _transform(self, df: DataFrame) -> DataFrame:
        x, classes = vector_to_array(self.getOrDefault(self.features)), self.getOrDefault(self.state)

        def score(constant, turn, centre):
            rows = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(c)).alias("c")) for w, c in zip(turn, centre, strict=True)])
            dot = lambda w: F.aggregate(F.zip_with(x, w, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
            return F.lit(constant) - 0.5 * F.aggregate(rows, F.lit(0.0), lambda t, r: t + F.pow(dot(r["w"]) - r["c"], F.lit(2.0))) if turn else F.lit(constant)

        by_class = {y: score(*rest) for y, *rest in classes}
        raw = F.array(*[by_class.get(k, F.lit(-1e300)) for k in range(max(by_class) + 1)])
        out = df.withColumn("_raw", raw).withColumn("_top", F.array_max("_raw"))
        out = out.withColumn("_odds", F.transform("_raw", lambda v: F.exp(v - F.col("_top"))))
        total = F.aggregate("_odds", F.lit(0.0), lambda t, v: t + v)
        out = out.withColumns({"rawPrediction": array_to_vector("_raw"), "probability": array_to_vector(F.transform("_odds", lambda v: v / total)), "prediction": (F.array_position("_raw", F.col("_top")) - 1).cast("double")})
        return out.drop("_raw", "_top", "_odds")
