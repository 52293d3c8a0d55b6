"""Explainable boosting: an additive model of binned features, one score table a feature and, if asked for, a pair of features.

Features are binned once. Then terms are boosted in turn: one aggregate adds up gradients and curvatures by bin, a few steps over the
bins are fitted to these sums, and a share of them is added to the term's table. What the driver sees of the rows is a sum a bin.
Scores are column expressions, so that no Python runs on rows.

Defined cases: missing values (NaN) have a bin of their own; a constant feature gets scores of 0; one class alone is always predicted.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

#: Bins of a feature within a pair.
COARSE = 8


def steps(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps over ordered bins: at most ``leaves`` ranges, cut greedily where the gain is greatest, a step a range."""
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        cuts = [(gain(a, m) + gain(m, b) - gain(a, b), -m, (a, b)) for a, b in ranges for m in range(a + 1, b) if h[a:m].sum() > 0 and h[m:b].sum() > 0]
        if not cuts or max(cuts)[0] <= 1e-12:
            break
        _, at, (a, b) = max(cuts)
        ranges.remove((a, b))
        ranges += [(a, -at), (-at, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


class _Terms:
    """Places of the terms in one flat table of scores: a term is (feature,) or (feature, feature)."""

    def __init__(self, features: int, width: int, pairs: list):
        self.width = width
        self.names = [(j,) for j in range(features)] + [tuple(p) for p in pairs]
        self.sizes = [width if len(t) == 1 else COARSE * COARSE for t in self.names]
        self.starts = [0, *itertools.accumulate(self.sizes)]

    def cell(self, term: tuple) -> str:
        """The row's cell of a term, from its array ``_b`` of bins."""
        return f"_b[{term[0]}]" if len(term) == 1 else pair_cell(*term, self.width)

    def scores(self, table: np.ndarray, intercepts: list[float], rows: DataFrame) -> DataFrame:
        """``rows`` with ``_s``, an array of scores; table: a row a score."""
        held = rows.withColumns({f"_w{k}": F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in own) + ")") for k, own in enumerate(table)})
        parts = [" + ".join([f"{float(intercepts[k])!r}D", *(f"get(_w{k}, {s} + {self.cell(t)})" for t, s in zip(self.names, self.starts, strict=False))]) for k in range(len(table))]
        return held.withColumn("_s", F.expr(f"array({', '.join(parts)})")).drop(*[f"_w{k}" for k in range(len(table))])


def pair_cell(i: int, j: int, width: int) -> str:
    return f"(_b[{i}] * {COARSE} div {width}) * {COARSE} + (_b[{j}] * {COARSE} div {width})"


def _bins(x, bounds: list[list[float]], width: int):
    """The bin of every feature: how many bounds lie below the value; the last bin for missing ones."""

    def own(v, below):
        held = F.lit(below) if below else F.expr("cast(array() as array<double>)")
        return F.when(v.isNull() | F.isnan(v), width - 1).otherwise(F.size(F.filter(held, lambda b: b < v))).cast("int")

    return F.array(*[own(x[j], below) for j, below in enumerate(bounds)])


def _chances(scores: int):
    """Probability of each class (of class 1 alone for one score), from ``_s``."""
    if scores == 1:
        return [1.0 / (1.0 + F.exp(-F.col("_s")[0]))]
    top = F.array_max("_s")
    parts = [F.exp(F.col("_s")[k] - top) for k in range(scores)]
    return [p / sum(parts[1:], parts[0]) for p in parts]


class AdditiveBoost(Estimator):
    """Cyclic boosting. Labels are 0 to n - 1; two classes have one score, more have one each. With ``pairs`` the pairs of features whose
    cells explain most of what the single features leave are boosted after them."""

    cycles = Param(Params._dummy(), "cycles", "times that each term is boosted", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "ranges of a step", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a step that is added", TypeConverters.toFloat)
    pairs = Param(Params._dummy(), "pairs", "pairs of features", TypeConverters.toInt)

    def __init__(self, cycles: int = 10, bins: int = 32, leaves: int = 3, rate: float = 0.5, pairs: int = 0, features: str = "features", label: str = "label"):
        super().__init__()
        self._setDefault(cycles=cycles, bins=bins, leaves=leaves, rate=rate, pairs=pairs)
        self.features, self.label = features, label

    def _fit(self, df: DataFrame) -> AdditiveModel:
        n_bins, width = self.getOrDefault(self.bins), self.getOrDefault(self.bins) + 1
        rows = df.select(vector_to_array(self.features).alias("_x"), F.col(self.label).cast("int").alias("y"))
        d = len(rows.first()._x)
        at = [k / n_bins for k in range(1, n_bins)]
        # Bins need no exact quantiles: they only say where a score may change.
        found = rows.agg(*[F.percentile_approx(F.nullif(F.col("_x")[j], F.lit(math.nan)), at) for j in range(d)]).first()
        bounds = [sorted(set(b or ())) for b in found]
        rows = settled(rows.select(_bins(F.col("_x"), bounds, width).alias("_b"), "y"), "bins")
        counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row a class
        classes, total = max(counts) + 1, sum(counts.values())
        shares = [max(counts.get(c, 0) / total, 1e-12) for c in range(classes)]
        intercepts = [math.log(shares[1] / shares[0])] if classes == 2 else [math.log(s) for s in shares]
        terms, table, n = _Terms(d, width, []), np.zeros((len(intercepts), d * width)), np.zeros(d * width)
        for _ in range(self.getOrDefault(self.cycles)):
            for t in range(d):
                self._boost(rows, terms, table, n, intercepts, t)
        chosen = self._choose(rows, terms, table, intercepts) if self.getOrDefault(self.pairs) and d > 1 else []
        if chosen:
            terms = _Terms(d, width, chosen)
            more = terms.starts[-1] - table.shape[1]
            table, n = np.pad(table, ((0, 0), (0, more))), np.pad(n, (0, more))
            for _ in range(self.getOrDefault(self.cycles)):
                for t in range(d, len(terms.names)):
                    self._boost(rows, terms, table, n, intercepts, t)
        gains = []
        for start, size in zip(terms.starts, terms.sizes, strict=False):  # each term has a mean of 0 over the rows
            own, weight = table[:, start : start + size], n[start : start + size] / total
            mean = own @ weight
            own -= mean[:, None]
            own[:, weight == 0] = 0.0
            intercepts = [a + float(m) for a, m in zip(intercepts, mean, strict=True)]
            gains.append(float((np.abs(own) @ weight).mean()))
        return AdditiveModel(bounds, [list(p) for p in chosen], table.tolist(), intercepts, classes, gains, width, self.features)

    def _sums(self, scored: DataFrame, key: list, scores: int) -> list:
        """Gradients and curvatures of each score by ``key``."""
        p = _chances(scores)
        mine = [F.when(F.col("y") == (1 if scores == 1 else k), 1.0).otherwise(0.0) for k in range(scores)]
        sums = [F.sum(mine[k] - p[k]).alias(f"g{k}") for k in range(scores)] + [F.sum(p[k] * (1 - p[k])).alias(f"h{k}") for k in range(scores)]
        return scored.groupBy(*key).agg(F.count("*").alias("n"), *sums).collect()  # a row a cell

    def _boost(self, rows: DataFrame, terms: _Terms, table: np.ndarray, n: np.ndarray, intercepts: list[float], t: int) -> None:
        start, size = terms.starts[t], terms.sizes[t]
        g, h = np.zeros((2, len(table), size))
        scored = terms.scores(table, intercepts, rows)
        for r in self._sums(scored, [F.expr(terms.cell(terms.names[t])).cast("int").alias("cell")], len(table)):
            n[start + r.cell] = r.n
            for k in range(len(table)):
                g[k, r.cell], h[k, r.cell] = r[f"g{k}"], r[f"h{k}"]
        for k in range(len(table)):
            if len(terms.names[t]) == 1:  # the bin of missing values stands alone
                step = np.append(steps(g[k, :-1], h[k, :-1], self.getOrDefault(self.leaves)), g[k, -1] / (h[k, -1] + 1.0))
            else:
                step = g[k] / (h[k] + 1.0)
            table[k, start : start + size] += self.getOrDefault(self.rate) * step

    def _choose(self, rows: DataFrame, terms: _Terms, table: np.ndarray, intercepts: list[float]) -> list[tuple[int, int]]:
        """The pairs whose cells explain most of the remaining gradients: one aggregate for all pairs."""
        all_pairs = list(itertools.combinations(range(len(terms.names)), 2))
        cells = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.expr(pair_cell(i, j, terms.width)).alias("cell")) for k, (i, j) in enumerate(all_pairs)]))
        scored = terms.scores(table, intercepts, rows).select("y", "_s", cells.alias("_c"))
        gain = np.zeros(len(all_pairs))
        for r in self._sums(scored, [F.col("_c.pair").alias("pair"), F.col("_c.cell").alias("cell")], len(table)):
            gain[r.pair] += sum(r[f"g{k}"] ** 2 / (r[f"h{k}"] + 1.0) for k in range(len(table)))
        best = sorted(range(len(all_pairs)), key=lambda k: (-gain[k], k))[: self.getOrDefault(self.pairs)]
        return [all_pairs[k] for k in sorted(best)]


class AdditiveModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    bounds = Param(Params._dummy(), "bounds", "bounds of the bins of each feature")
    pairs = Param(Params._dummy(), "pairs", "pairs of features")
    table = Param(Params._dummy(), "table", "a list of scores a class")
    intercepts = Param(Params._dummy(), "intercepts", "score of no term", TypeConverters.toListFloat)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    gains = Param(Params._dummy(), "gains", "mean absolute score of each term", TypeConverters.toListFloat)
    width = Param(Params._dummy(), "width", "bins of a feature, that of missing values included", TypeConverters.toInt)
    features = Param(Params._dummy(), "features", "name of the vector column", TypeConverters.toString)

    def __init__(self, bounds=(), pairs=(), table=(), intercepts=(), classes: int = 2, gains=(), width: int = 1, features: str = "features"):
        super().__init__()
        self._set(bounds=list(bounds), pairs=list(pairs), table=list(table), intercepts=list(intercepts), classes=classes, gains=list(gains), width=width, features=features)

    @property
    def featureImportances(self):
        """Mean absolute scores; that of a pair counts half for either feature."""
        from pyspark.ml.linalg import DenseVector

        d, gains = len(self.getOrDefault(self.bounds)), self.getOrDefault(self.gains)
        out = np.array(gains[:d])
        for (i, j), gain in zip(self.getOrDefault(self.pairs), gains[d:], strict=True):
            out[[i, j]] += gain / 2
        return DenseVector(out.tolist())

    def _terms(self) -> _Terms:
        return _Terms(len(self.getOrDefault(self.bounds)), self.getOrDefault(self.width), self.getOrDefault(self.pairs))

    def shapes(self, names: list[str] | None = None) -> DataFrame:
        """The model itself, a row a feature, bin and score: (feature, above, up_to, class, score). A bin holds values above ``above`` up to
        ``up_to``; both are null for missing values."""
        rows, terms = [], self._terms()
        for j, b in enumerate(self.getOrDefault(self.bounds)):
            ends = [*zip([None, *b], [*b, None], strict=True)]
            for k, own in enumerate(self.getOrDefault(self.table)):
                of = own[terms.starts[j] : terms.starts[j + 1]]
                label = k if self.getOrDefault(self.classes) > 2 else 1
                rows += [(names[j] if names else str(j), low, high, label, of[c]) for c, (low, high) in enumerate(ends)] if b else []
                rows.append((names[j] if names else str(j), None, None, label, of[-1]))
        return SparkSession.active().createDataFrame(rows, "feature string, above double, up_to double, class int, score double")

    def _transform(self, df: DataFrame) -> DataFrame:
        binned = df.withColumn("_b", _bins(vector_to_array(self.getOrDefault(self.features)), self.getOrDefault(self.bounds), self.getOrDefault(self.width)))
        intercepts = self.getOrDefault(self.intercepts)
        scored = self._terms().scores(np.array(self.getOrDefault(self.table)), intercepts, binned)
        p = _chances(len(intercepts))
        p, raw = ([1 - p[0], p[0]], F.array(-F.col("_s")[0], F.col("_s")[0])) if len(p) == 1 else (p, F.col("_s"))
        out = scored.withColumn("_p", F.array(*p)).withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector("_p")})
        return out.withColumn("prediction", (F.array_position("_p", F.array_max("_p")) - 1).cast("double")).drop("_p", "_s", "_b")
