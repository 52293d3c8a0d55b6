"""Feature selection: fit on training rows, transform any."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.scalar import quoted
from .neighbours import relief_scores
from .shap import mean_effects
from .stats import _corr_array, adjust_pvalues


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one distinct value, NULL one of them: one pass."""
    r = df.agg(*[(F.coalesce(F.min(quoted(c)) != F.max(quoted(c)), F.lit(False)) | ((F.count(quoted(c)) > 0) & (F.count(quoted(c)) < F.count("*")))).alias(c) for c in columns]).first()
    return [c for c in columns if r[c]]


def anova_scores(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, f, p, n, k): ANOVA F of every feature from sums by (feature, class) in long form; p on the driver."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), quoted(c).cast("double").alias("v")) for c in columns])
    rows = df.filter(quoted(target).isNotNull()).select(quoted(target).alias("y"), F.explode(cells).alias("x")).select("y", "x.*").filter("v is not null")
    per = rows.groupBy("feature", "y").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("s"))
    sums = per.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("within"))
    between = F.col("b") - F.col("t") * F.col("t") / F.col("n")
    f = (between / (F.col("k") - 1)) / F.when(F.col("within") > 0, F.col("within") / (F.col("n") - F.col("k")))
    return sums.filter("k > 1 and n > k").select("feature", f.alias("f"), "n", "k")


def scored(df: DataFrame, columns: list[str], target: str, task: str = "classification", scorer: str | Callable | None = None) -> dict[str, tuple[float, float]]:
    """{feature: (score, p)}: f_classif, f_regression, mutual_info (binned), or a function (df, feature, target) -> (score, p)."""
    if callable(scorer):
        return {c: scorer(df, c, target) for c in columns}
    name = scorer or ("f_classif" if task == "classification" else "f_regression")
    if name == "f_classif":
        out = {r.feature: (r.f, S.f_sf(r.f, r.k - 1, r.n - r.k)) for r in anova_scores(df, columns, target).collect() if r.f is not None}
    elif name == "f_regression":
        r = df.agg(F.count("*"), *[F.corr(quoted(c), quoted(target)) for c in columns]).first()
        out = {}
        for c, x in zip(columns, r[1:], strict=True):
            if x is not None and not math.isnan(x):
                f = x * x / max(1e-300, 1 - x * x) * (r[0] - 2)
                out[c] = (f, S.f_sf(f, 1, r[0] - 2))
    elif name.startswith("mutual_info"):
        out = {c: (mutual_information(df, c, target), math.nan) for c in columns}
    else:
        raise ValueError(f"unknown scorer {name}")
    return {c: out.get(c, (0.0, 1.0)) for c in columns}


def mutual_information(df: DataFrame, column: str, target: str, bins: int = 10) -> float:
    from ..functions.scalar import range_bucket

    joint = df.select(range_bucket(df, column, bins).alias("x"), quoted(target).alias("y")).dropna().groupBy("x", "y").count().toPandas()
    n = joint["count"].sum()
    px, py = joint.groupby("x")["count"].sum() / n, joint.groupby("y")["count"].sum() / n
    return float(sum(r["count"] / n * math.log(r["count"] / n / px[r.x] / py[r.y]) for r in joint.to_dict("records")))


#: Rows of a bucket within which values are moved.
SHUFFLE_ROWS = 10_000


def shuffle_buckets(df: DataFrame) -> int:
    return max(1, df.count() // SHUFFLE_ROWS)


def hashed_shuffle(df: DataFrame, columns: list[str], seed: int, buckets: int | None = None) -> DataFrame:
    """``df`` with each column's values moved to other rows, in hashed buckets of some ``SHUFFLE_ROWS`` rows: a permutation without a global
    order. A small table is one bucket."""
    buckets = buckets or shuffle_buckets(df)
    own = F.xxhash64(*[quoted(c) for c in df.columns], F.lit(seed))
    rows = df.withColumns({"_o": own, "_b": F.pmod(own, F.lit(buckets))})
    for k, c in enumerate(columns):
        order = Window.partitionBy("_b").orderBy(F.xxhash64("_o", F.lit(seed + k)))
        moved = F.coalesce(F.lead(quoted(c)).over(order), F.first(quoted(c)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        rows = rows.withColumn(f"_s{k}", moved)
    return rows.select(*[F.col(f"_s{columns.index(c)}").alias(c) if c in columns else quoted(c) for c in df.columns])


def _assembled(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df.select(*[quoted(c).cast("double").alias(c) for c in columns], quoted(target).cast("double").alias(target)).fillna(0.0))


def _importance(df: DataFrame, columns: list[str], target: str, task: str, seed: int) -> np.ndarray:
    return _forest(df, columns, target, task, seed)[0].featureImportances.toArray()


def _forest(df: DataFrame, columns: list[str], target: str, task: str, seed: int):
    """(the default forest, its training rows)"""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    rows = _assembled(df, columns, target)
    return kind(featuresCol="_x", labelCol=target, numTrees=20, seed=seed, maxDepth=5).fit(rows), rows


def _weights(df: DataFrame, columns: list[str], target: str, task: str, l1: float = 0.0) -> np.ndarray:
    """Mean absolute weights of a linear model on standardised features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    rows = _assembled(df, columns, target)
    s = df.agg(*[F.coalesce(F.stddev_samp(quoted(c)), F.lit(0.0)) for c in columns]).first()
    if task == "classification":
        w = np.abs(LogisticRegression(featuresCol="_x", labelCol=target, maxIter=50, regParam=0.01, elasticNetParam=l1).fit(rows).coefficientMatrix.toArray()).mean(0)
    else:
        w = np.abs(LinearRegression(featuresCol="_x", labelCol=target, maxIter=50, regParam=0.01, elasticNetParam=1.0).fit(rows).coefficients.toArray())
    return w * np.array(s, float)


class FeatureSelector:
    """fit, transform and fit_transform by one of METHODS; selected columns keep their order."""

    METHODS = ("k_best", "fdr", "select_from_model", "rfe", "boruta", "shap", "mrmr", "relief", "adversarial", "permutation", "genetic", "stability", "knockoff", "null_importance", "tree_importance", "correlation")

    def __init__(self, method: str = "fdr", task: str = "classification", param: float = 0.05, scorer=None, seed: int = 123, **options):
        if method not in self.METHODS:
            raise ValueError(f"unknown method {method}; available: {', '.join(self.METHODS)}")
        self.method, self.task, self.param, self.scorer, self.seed, self.options = method, task, param, scorer, seed, options
        self.selected: list[str] | None = None

    @staticmethod
    def available() -> list[str]:
        return list(FeatureSelector.METHODS)

    def fit(self, df: DataFrame, columns: list[str], target: str, test: DataFrame | None = None) -> FeatureSelector:
        columns = varying(df, columns)
        keep = set(getattr(self, f"_{self.method}")(df, columns, target, test)) if columns else set()
        self.selected = [c for c in columns if c in keep]
        return self

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        if self.selected is None:
            raise RuntimeError("fit first")
        return df.select(*[quoted(c) for c in (*keep, *self.selected)])

    def fit_transform(self, df: DataFrame, columns: list[str], target: str) -> DataFrame:
        return self.fit(df, columns, target).transform(df, [target])

    def _count(self, columns) -> int:
        return max(1, int(self.param * len(columns))) if self.param < 1 else min(int(self.param), len(columns))

    def _top(self, columns, values, k=None) -> list[str]:
        return [c for _, c in sorted(zip([-v for v in values], columns, strict=True))[: k or self._count(columns)]]

    def _k_best(self, df, columns, target, test):
        s = scored(df, columns, target, self.task, self.scorer)
        return self._top(columns, [s[c][0] for c in columns])

    def _fdr(self, df, columns, target, test):
        s = scored(df, columns, target, self.task, self.scorer)
        adjusted = adjust_pvalues([s[c][1] for c in columns], "fdr_bh")["p_adjusted"]
        return [c for c, p in zip(columns, adjusted, strict=True) if p <= self.param]

    def _select_from_model(self, df, columns, target, test):
        w = _weights(df, columns, target, self.task)
        return [c for c, x in zip(columns, w, strict=True) if x >= np.median(w)]

    def _rfe(self, df, columns, target, test):
        own, k = list(columns), self._count(columns)
        while len(own) > k:
            w = _weights(df, own, target, self.task)
            drop = set(np.argsort(w)[: max(1, min(len(own) - k, len(own) // 10))].tolist())
            own = [c for j, c in enumerate(own) if j not in drop]
        return own

    def _tree_importance(self, df, columns, target, test):
        return self._top(columns, _importance(df, columns, target, self.task, self.seed))

    def _boruta(self, df, columns, target, test):
        rounds, hits, buckets = self.options.get("rounds", 5), np.zeros(len(columns)), shuffle_buckets(df)
        for r in range(rounds):
            shadow = {c: f"_shadow{k}" for k, c in enumerate(columns)}
            both = df.withColumns({s: quoted(c) for c, s in shadow.items()})
            both = hashed_shuffle(both, list(shadow.values()), self.seed + r, buckets)
            w = _importance(both, [*columns, *shadow.values()], target, self.task, self.seed + r)
            hits += w[: len(columns)] > w[len(columns) :].max()
        return [c for c, h in zip(columns, hits, strict=True) if S.binom_two_sided(int(h), rounds) <= 0.1 and h > rounds / 2]

    def _null_importance(self, df, columns, target, test):
        real, rounds = _importance(df, columns, target, self.task, self.seed), self.options.get("rounds", 3)
        buckets = shuffle_buckets(df)
        null = [_importance(hashed_shuffle(df, [target], self.seed + r + 1, buckets), columns, target, self.task, self.seed) for r in range(rounds)]
        return [c for j, c in enumerate(columns) if real[j] > max(x[j] for x in null)]

    def _permutation(self, df, columns, target, test):
        return self._top(columns, permutation_effects(df, columns, target, self.task, self.seed))

    def _shap(self, df, columns, target, test):
        """By mean absolute Shapley values of the default forest over all rows."""
        model, rows = _forest(df, columns, target, self.task, self.seed)
        return self._top(columns, mean_effects(model, rows, "_x"))

    def _mrmr(self, df, columns, target, test):
        s = scored(df, columns, target, self.task, self.scorer)
        corr, own = np.abs(np.nan_to_num(_corr_array(df.fillna(0), columns)[0])), []
        while len(own) < self._count(columns):
            left = [j for j in range(len(columns)) if j not in own]
            own.append(max(left, key=lambda j: s[columns[j]][0] / (1e-9 + (corr[j, own].mean() if own else 1.0))))
        return [columns[j] for j in own]

    def _relief(self, df, columns, target, test):
        return self._top(columns, relief_scores(df, target, columns))

    def _adversarial(self, df, columns, target, test):
        if test is None:
            return columns
        both = df.select(*columns).withColumn("_part", F.lit(0.0)).unionByName(test.select(*columns).withColumn("_part", F.lit(1.0)))
        s = scored(both, columns, "_part")
        return [c for c in columns if s[c][1] > self.param]

    def _genetic(self, df, columns, target, test):
        from .ml import quick_accuracy

        rng, size = np.random.default_rng(self.seed), self.options.get("population", 6)
        masks = rng.random((size, len(columns))) < 0.5
        fitness = lambda m: quick_accuracy(df, [c for c, k in zip(columns, m, strict=True) if k], target) - 0.001 * m.sum() if m.any() else -1
        score = [fitness(m) for m in masks]
        for _ in range(self.options.get("generations", 3)):
            a, b = rng.choice(np.argsort(score)[-max(2, size // 2) :], 2, replace=False)
            child = np.where(rng.random(len(columns)) < 0.5, masks[a], masks[b]) ^ (rng.random(len(columns)) < 0.05)
            worst = int(np.argmin(score))
            if (s := fitness(child)) > score[worst]:
                masks[worst], score[worst] = child, s
        return [c for c, k in zip(columns, masks[int(np.argmax(score))], strict=True) if k]

    def _stability(self, df, columns, target, test):
        rounds, hits, buckets = self.options.get("rounds", 5), np.zeros(len(columns)), shuffle_buckets(df)
        for r in range(rounds):
            half = df.filter(F.pmod(F.xxhash64(*[quoted(c) for c in columns], F.lit(self.seed + r)), F.lit(2)) == 0)
            hits += _weights(half, columns, target, self.task, l1=1.0) > 1e-6
        return [c for c, h in zip(columns, hits, strict=True) if h / rounds >= self.options.get("threshold", 0.6)]

    def _knockoff(self, df, columns, target, test):
        """Importance differences between columns and second-order knockoffs (equicorrelated construction)."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation

        p = len(columns)
        corr = np.nan_to_num(Correlation.corr(VectorAssembler(inputCols=columns, outputCol="_x").transform(df.select(*columns).fillna(0.0)), "_x").first()[0].toArray())
        s = min(1.0, 2 * float(np.linalg.eigvalsh(corr)[0])) * 0.999
        s = max(s, 1e-3)
        mean_map = np.eye(p) - s * np.linalg.pinv(corr)
        cov = 2 * s * np.eye(p) - s * s * np.linalg.pinv(corr)
        root = np.linalg.cholesky(cov + 1e-6 * np.eye(p))
        stats = df.agg(*[F.avg(quoted(c)) for c in columns], *[F.coalesce(F.stddev_samp(quoted(c)), F.lit(1.0)) for c in columns]).first()
        z = [(quoted(c) - stats[j]) / (stats[p + j] or 1.0) for j, c in enumerate(columns)]
        noise = [F.randn(self.seed + j) for j in range(p)]
        made = {f"_k{j}": sum((float(mean_map[j, i]) * z[i] for i in range(p)), F.lit(0.0)) + sum((float(root[j, i]) * noise[i] for i in range(j + 1)), F.lit(0.0)) for j in range(p)}
        both = df.fillna(0.0).withColumns(made)
        w = _weights(both, [*columns, *made], target, self.task, l1=1.0)
        d = w[:p] - w[p:]
        levels = sorted({abs(x) for x in d if x})
        cut = next((t for t in levels if (1 + (d <= -t).sum()) / max(1, (d >= t).sum()) <= self.options.get("fdr", 0.2)), math.inf)
        return [c for c, x in zip(columns, d, strict=True) if x >= cut]

    def _correlation(self, df, columns, target, test):
        corr, keep = np.abs(np.nan_to_num(_corr_array(df.fillna(0), columns)[0])), []
        for j in range(len(columns)):
            if all(corr[j, k] <= self.options.get("threshold", 0.95) for k in keep):
                keep.append(j)
        return [columns[j] for j in keep]


def permutation_effects(df: DataFrame, columns: list[str], target: str, task: str = "classification", seed: int = 123) -> list[float]:
    """Loss of accuracy (or gain in squared error) when a column's values are shuffled."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.regression import LinearRegression

    kind = LogisticRegression if task == "classification" else LinearRegression
    model = kind(featuresCol="_x", labelCol=target, maxIter=50, regParam=0.01).fit(_assembled(df, columns, target))

    def loss(rows):
        out = model.transform(_assembled(rows, columns, target))
        gap = F.when(F.col("prediction") != quoted(target), 1.0).otherwise(0.0) if task == "classification" else F.pow(F.col("prediction") - quoted(target), F.lit(2))
        return out.agg(F.avg(gap)).first()[0] or 0.0

    base, buckets = loss(df), shuffle_buckets(df)
    return [loss(hashed_shuffle(df.select(*columns, target), [c], seed + j, buckets)) - base for j, c in enumerate(columns)]
