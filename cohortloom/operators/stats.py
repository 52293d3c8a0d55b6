"""Classical statistics: Spark aggregates give the sufficient numbers, distribution functions the p-values.

Every function takes a DataFrame and column names; two samples are one column and a group column of two values, or two
columns where pairs matter. Results are dictionaries of numbers.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.scalar import average_ranks, exact_quantiles, is_numeric, quoted, range_bucket, running_sums, safe_divide, with_buckets
from ..session import settled

SHAPIRO_ROWS = 5000


def _num(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[quoted(c).cast("double").alias(c) for c in columns])


# Describe


def summary_statistics(df: DataFrame, variables: list[str]) -> DataFrame:
    """A row a variable: counts, moments, quartiles, bias-corrected skewness and excess kurtosis."""
    kinds = dict(df.dtypes)
    for v in variables:
        if v not in kinds:
            raise KeyError(v)
        if not is_numeric(kinds[v]):
            raise ValueError(f"{v} is not numeric")
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), quoted(v).cast("double").alias("v")) for v in variables])
    rows = df.select(F.explode(cells).alias("x")).select("x.*")
    g = rows.groupBy("variable").agg(F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"))
    g = g.join(exact_quantiles(rows, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["variable"]), "variable", "left")
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return g.select("variable", "n", "n_missing", (100.0 * F.col("n_missing") / (n + F.col("n_missing"))).alias("pct_missing"), "mean", "median", "std", "min", "max", "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), skew.alias("skewness"), kurt.alias("kurtosis"))


def normality_test(df: DataFrame, variable: str, method: str = "shapiro") -> dict:
    v = _num(df, variable).filter(quoted(variable).isNotNull())
    n, m, s = v.agg(F.count("*"), F.avg(variable), F.stddev_samp(variable)).first()
    if n < 3:
        raise ValueError("at least 3 values are needed")
    if method == "shapiro":
        if n <= SHAPIRO_ROWS:
            w, p = S.shapiro_wilk(sorted(r[0] for r in v.collect()))
        else:
            w, p = _shapiro_sums(v, variable, n, m, s)
        return {"test": "shapiro", "statistic": w, "p_value": p, "n": n}
    if method == "ks":
        from pyspark.ml.stat import KolmogorovSmirnovTest

        r = KolmogorovSmirnovTest.test(v, variable, "norm", m, s).first()
        return {"test": "ks", "statistic": r.statistic, "p_value": r.pValue, "n": n}
    raise ValueError(f"unknown test {method}")


def _shapiro_sums(v: DataFrame, variable: str, n: int, m: float, s: float) -> tuple[float, float]:
    """Shapiro-Wilk over all values: normal scores are summed by ranges of ranks, so that neither many rows nor many
    equal values meet in one task."""
    step = 100_000
    top = F.col("rank") + (F.col("ties") - 1) / 2
    ranks = average_ranks(v, variable).select((quoted(variable) - m).alias("x"), (top - F.col("ties") + 1).cast("bigint").alias("lo"), top.cast("bigint").alias("hi"))
    parts = ranks.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(step)))).withColumn("hi", F.least("hi", F.col("lo") + step - 1)).repartition("lo")

    def scores(batches):
        for b in batches:
            mm = mx = 0.0
            for x, lo, hi in zip(b["x"], b["lo"], b["hi"], strict=True):
                own = [S.normal_ppf((k - 0.375) / (n + 0.25)) for k in range(lo, hi + 1)]
                mm += math.fsum(y * y for y in own)
                mx += x * math.fsum(own)
            yield pd.DataFrame({"mm": [mm], "mx": [mx]})

    mm, mx = parts.mapInPandas(scores, "mm double, mx double").agg(F.sum("mm"), F.sum("mx")).first()
    low, high = ([r[0] for r in v.orderBy(o).limit(2).collect()] for o in (quoted(variable).asc(), quoted(variable).desc()))
    return S.shapiro_wilk_sums(n, mm, mx, (low[0], low[1], high[1], high[0]), s * s * (n - 1))


def missingness_report(df: DataFrame) -> dict:
    """Missing counts by column, and a chi-square of these counts against their mean."""
    r = df.agg(F.count("*").alias("_n"), *[F.count_if(quoted(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    n = r.pop("_n")
    mean = sum(r.values()) / max(1, len(r))
    stat = sum((x - mean) ** 2 / mean for x in r.values()) if mean else 0.0
    return {"n_rows": n, "columns": {c: {"n_missing": k, "pct_missing": 100.0 * k / n if n else 0.0} for c, k in r.items()}, "chi2": stat, "dof": len(r) - 1, "p_value": S.chi2_sf(stat, len(r) - 1) if len(r) > 1 and mean else 1.0}


# Compare


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    x = quoted(value).cast("double")
    return df.filter(x.isNotNull() & quoted(group).isNotNull()).groupBy(quoted(group).alias("group")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def _two(df: DataFrame, value: str, group: str):
    rows = sorted(group_moments(df, value, group).limit(3).collect(), key=lambda r: r.group)
    if len(rows) != 2:
        raise ValueError("two groups are needed")
    return rows


def _cohen(a, b) -> float:
    if a.n < 2 or b.n < 2:
        return math.nan
    pooled = ((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / (a.n + b.n - 2)
    return (a.mean - b.mean) / math.sqrt(pooled) if pooled > 0 else math.nan


def cohens_d(df: DataFrame, value: str, group: str) -> float:
    return _cohen(*_two(df, value, group))


def hedges_g(df: DataFrame, value: str, group: str) -> float:
    """Cohen's d times the small-sample correction; n counts all rows, null values too."""
    n = df.filter(quoted(group).isNotNull()).count()
    return cohens_d(df, value, group) * (1 - 3 / (4 * n - 9))


def independent_ttest(df: DataFrame, value: str, group: str) -> dict:
    a, b = _two(df, value, group)
    df_ = a.n + b.n - 2
    pooled = ((a.n - 1) * a["var"] + (b.n - 1) * b["var"]) / df_
    t = (a.mean - b.mean) / math.sqrt(pooled * (1 / a.n + 1 / b.n)) if pooled else math.nan
    d = _cohen(a, b)
    return {"statistic": t, "p_value": S.t_sf2(t, df_), "df": df_, "mean_a": a.mean, "mean_b": b.mean, "cohens_d": d, "hedges_g": d * (1 - 3 / (4 * (a.n + b.n) - 9))}


def welch_ttest(df: DataFrame, value: str, group: str) -> dict:
    a, b = _two(df, value, group)
    va, vb = a["var"] / a.n, b["var"] / b.n
    t = (a.mean - b.mean) / math.sqrt(va + vb)
    df_ = (va + vb) ** 2 / (va**2 / (a.n - 1) + vb**2 / (b.n - 1))
    return {"statistic": t, "p_value": S.t_sf2(t, df_), "df": df_, "mean_a": a.mean, "mean_b": b.mean, "cohens_d": _cohen(a, b)}


def paired_ttest(df: DataFrame, a: str, b: str) -> dict:
    n, m, s = _num(df, a, b).dropna().agg(F.count("*"), F.avg(quoted(a) - quoted(b)), F.stddev_samp(quoted(a) - quoted(b))).first()
    t = m / (s / math.sqrt(n)) if s else math.nan
    return {"statistic": t, "p_value": S.t_sf2(t, n - 1), "df": n - 1, "mean_difference": m, "n": n, "cohens_d": m / s if s else math.nan}


def _rank_sums(df: DataFrame, value: str, group: str):
    """Per group n, rank sum and median; sum of t^3 - t over ties."""
    rows = df.select(quoted(value).cast("double").alias("v"), quoted(group).alias("g")).dropna()
    ranks = average_ranks(rows, "v")
    joined = rows.groupBy("v", "g").agg(F.count("*").alias("n")).join(ranks, "v")
    sums = joined.groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("r2"))
    medians = exact_quantiles(rows, "v", {"median": 0.5}, ["g"])
    ties = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties"))).first()[0] or 0.0
    return sorted(sums.join(medians, "g").collect(), key=lambda r: r.g), ties


def mann_whitney(df: DataFrame, value: str, group: str, alternative: str = "two-sided") -> dict:
    (a, b), ties = _rank_sums(df, value, group)
    u, n = a.r - a.n * (a.n + 1) / 2, a.n + b.n
    if min(a.n, b.n) <= 8 and not ties:
        counts = np.zeros(a.n * b.n + 1)
        counts[0] = 1
        for k in range(1, a.n + 1):  # generating function of U
            new = np.convolve(counts, np.bincount([0, b.n + k], [1, -1]))[: len(counts)]
            counts = np.array([new[j::k].cumsum() for j in range(k)], dtype=object)
            full = np.zeros(a.n * b.n + 1)
            for j in range(k):
                full[j::k] = counts[j]
            counts = full
        pmf = counts / counts.sum()
        hi, lo = pmf[int(u) :].sum(), pmf[: int(u) + 1].sum()
        p = {"greater": hi, "less": lo}.get(alternative, min(1.0, 2 * min(hi, lo)))
    else:
        mean, sd = a.n * b.n / 2, math.sqrt(a.n * b.n / 12 * (n + 1 - ties / (n * (n - 1))))
        if alternative == "greater":
            p = S.normal_sf((u - mean - 0.5) / sd)
        elif alternative == "less":
            p = S.normal_sf((mean - u - 0.5) / sd)
        else:
            p = min(1.0, 2 * S.normal_sf((abs(u - mean) - 0.5) / sd))
    return {"statistic": u, "p_value": float(p), "median_a": a.median, "median_b": b.median, "n_a": a.n, "n_b": b.n}


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str) -> dict:
    d = _num(df, a, b).dropna().select((quoted(a) - quoted(b)).alias("d")).filter("d <> 0").select(F.abs("d").alias("v"), F.signum("d").alias("s"))
    ranks = average_ranks(d, "v")
    r = d.groupBy("v", "s").agg(F.count("*").alias("n")).join(ranks, "v").agg(F.sum(F.when(F.col("s") > 0, F.col("n") * F.col("rank"))).alias("up"), F.sum(F.when(F.col("s") < 0, F.col("n") * F.col("rank"))).alias("down"), F.sum("n").alias("n")).first()
    ties = ranks.agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties"))).first()[0] or 0.0
    n, up, down = r.n or 0, r.up or 0.0, r.down or 0.0
    w = min(up, down)
    if n and n <= 50 and not ties:
        counts = np.ones(1)
        for k in range(1, n + 1):
            counts = np.convolve(counts, np.bincount([0, k], [1, 1]))
        p = min(1.0, 2 * counts[: int(w) + 1].sum() / counts.sum())
    else:
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) if n else math.nan
        p = min(1.0, 2 * S.normal_sf((n * (n + 1) / 4 - w) / sd)) if n else math.nan
    return {"statistic": w, "p_value": float(p), "n": n}


def one_way_anova(df: DataFrame, value: str, group: str) -> dict:
    g = sorted(group_moments(df, value, group).collect(), key=lambda r: r.group)
    if len(g) < 2:
        raise ValueError("at least two groups are needed")
    n = sum(r.n for r in g)
    grand = sum(r.n * r.mean for r in g) / n
    between = sum(r.n * (r.mean - grand) ** 2 for r in g)
    within = sum((r.n - 1) * (r["var"] or 0.0) for r in g)
    d1, d2 = len(g) - 1, n - len(g)
    f = (between / d1) / (within / d2) if within else math.inf
    return {"statistic": f, "p_value": S.f_sf(f, d1, d2), "df_between": d1, "df_within": d2, "eta_squared": between / (between + within) if between + within else math.nan, "groups": {r.group: {"n": r.n, "mean": r.mean} for r in g}}


def eta_squared(df: DataFrame, value: str, group: str) -> float:
    return one_way_anova(df, value, group)["eta_squared"]


def kruskal_wallis(df: DataFrame, value: str, group: str) -> dict:
    g, ties = _rank_sums(df, value, group)
    n = sum(r.n for r in g)
    spread = 1 - ties / (n**3 - n) if n > 1 else 0.0
    if spread <= 0 or len(g) < 2:  # all values are equal, or there is nothing to compare
        return {"statistic": math.nan, "p_value": math.nan, "df": max(len(g) - 1, 0), "medians": {r.g: r.median for r in g}}
    h = (12 / (n * (n + 1)) * sum(r.r**2 / r.n for r in g) - 3 * (n + 1)) / spread
    return {"statistic": h, "p_value": S.chi2_sf(h, len(g) - 1), "df": len(g) - 1, "medians": {r.g: r.median for r in g}}


def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> list[dict]:
    g = sorted(group_moments(df, value, group).collect(), key=lambda r: r.group)
    d2 = sum(r.n for r in g) - len(g)
    if d2 < 1:
        raise ValueError("a group of at least two values is needed")
    mse = sum((r.n - 1) * (r["var"] or 0.0) for r in g) / d2
    crit = S.studentized_range_ppf(1 - alpha, len(g), d2)
    out = []
    for a, b in itertools.combinations(g, 2):
        se = math.sqrt(mse / 2 * (1 / a.n + 1 / b.n))
        diff = b.mean - a.mean
        # Without variance a difference is certain, and equal means say nothing.
        p = S.studentized_range_sf(abs(diff) / se, len(g), d2) if se > 0 else 0.0 if diff else math.nan
        out.append({"group_a": a.group, "group_b": b.group, "difference": diff, "p_adj": p, "ci_low": diff - crit * se, "ci_high": diff + crit * se, "reject": p < alpha})
    return out


def dunn_posthoc(df: DataFrame, value: str, group: str, p_adjust: str = "holm") -> list[dict]:
    g, ties = _rank_sums(df, value, group)
    n = sum(r.n for r in g)
    base = n * (n + 1) / 12 - ties / (12 * (n - 1)) if n > 1 else 0.0
    out = []
    for a, b in itertools.combinations(g, 2):
        z = (a.r / a.n - b.r / b.n) / math.sqrt(base * (1 / a.n + 1 / b.n)) if base > 1e-9 * n * n else math.nan
        out.append({"group_a": a.g, "group_b": b.g, "z": z, "p_value": 2 * S.normal_sf(abs(z))})
    if any(math.isnan(r["z"]) for r in out):  # all values are equal
        return [r | {"p_adj": math.nan} for r in out]
    for row, p in zip(out, adjust_pvalues([r["p_value"] for r in out], p_adjust)["p_adjusted"], strict=True):
        row["p_adj"] = p
    return out


def contingency(df: DataFrame, a: str, b: str) -> list[list[int]]:
    counts = {(r[0], r[1]): r[2] for r in df.select(quoted(a), quoted(b)).dropna().groupBy(a, b).count().collect()}
    rows, cols = sorted({k[0] for k in counts}), sorted({k[1] for k in counts})
    return [[counts.get((r, c), 0) for c in cols] for r in rows]


def chi_square(table: list[list[float]]) -> dict:
    t = np.asarray(table, float)
    expected = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    dof = (t.shape[0] - 1) * (t.shape[1] - 1)
    gap = np.abs(t - expected)
    if dof == 1:
        gap = np.maximum(0, gap - np.minimum(0.5, gap))
    stat = float((gap**2 / expected).sum())
    return {"statistic": stat, "p_value": S.chi2_sf(stat, dof), "dof": dof, "expected": expected.tolist()}


def fisher_exact(table: list[list[int]]) -> dict:
    if np.shape(table) != (2, 2):
        raise ValueError("a 2x2 table is needed")
    (a, b), (c, d) = table
    return {"odds_ratio": a * d / (b * c) if b * c else math.inf, "p_value": S.hypergeom_two_sided(a, b, c, d)}


def mcnemar(b: int, c: int, exact: bool = True) -> dict:
    if exact:
        return {"statistic": float(min(b, c)), "p_value": min(1.0, S.binom_two_sided(min(b, c), b + c)) if b + c else 1.0}
    stat = (abs(b - c) - 1) ** 2 / (b + c) if b + c else 0.0
    return {"statistic": stat, "p_value": S.chi2_sf(stat, 1)}


# Correlate


def _fisher_p(r: float, df_: float) -> float:
    return S.t_sf2(r * math.sqrt(df_ / max(1e-300, 1 - r * r)), df_) if abs(r) < 1 else 0.0


def spearman(pairs: DataFrame, n: int) -> float:
    """Pearson's r of mid-ranks. Ranks are joined to distinct (x, y) cells, weighted by their counts: a value that very
    many rows share meets its rank once a cell."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("c"))
    middle = (n + 1) / 2
    for k in ("x", "y"):
        ranks = average_ranks(pairs, k).select(F.col(k).alias(f"_{k}"), (F.col("rank") - middle).alias(f"r{k}"))
        cells = cells.join(ranks, F.col(k) == F.col(f"_{k}"))
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    xy, xx, yy = cells.agg(F.sum(c * x * y), F.sum(c * x * x), F.sum(c * y * y)).first()
    return xy / math.sqrt(xx * yy) if xx and yy else math.nan


def correlate_pair(df: DataFrame, x: str, y: str, method: str = "pearson") -> dict:
    pairs = df.select(quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y")).dropna()
    n = pairs.count()
    if n < 3:
        raise ValueError("at least 3 complete pairs are needed")
    if method == "pearson":
        r = pairs.agg(F.corr("x", "y")).first()[0]
        return {"r": r, "p_value": _fisher_p(r, n - 2), "n": n}
    if method == "spearman":
        r = spearman(pairs, n)
        return {"r": r, "p_value": _fisher_p(r, n - 2), "n": n}
    if method == "kendall":
        return kendall(pairs, n)
    raise ValueError(f"unknown method {method}")


def kendall(pairs: DataFrame, n: int) -> dict:
    """Tau-b and its p: exact up to 33 pairs without ties (and where a single pair or none is out of order), else normal with the variance
    corrected for ties. Pairs in and out of order are counted in range buckets of both columns."""
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("a")).withColumn("b", F.col("a"))
    lower, _, higher = dominance_counts(cells)
    ties = []
    for k in ("x", "y"):
        t = F.col("t").cast("double")
        sums = [t * (t - 1) / 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5)]
        ties.append(pairs.groupBy(k).agg(F.count("*").alias("t")).agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums]).first())
    (xt, x0, x1), (yt, y0, y1) = ties
    total = n * (n - 1) / 2
    if total in (xt, yt):
        return {"r": math.nan, "p_value": math.nan, "n": n}
    tau = max(-1.0, min(1.0, (lower - higher) / math.sqrt((total - xt) * (total - yt))))
    fewer = min(higher, total - higher)
    if not xt and not yt and (n <= 33 or fewer <= 1):
        p = S.kendall_exact_p(n, int(fewer))
    else:
        m = n * (n - 1.0)
        var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + x0 * y0 / (9 * m * (n - 2))
        p = 2 * S.normal_sf(abs(lower - higher) / math.sqrt(var)) if var > 0 else math.nan
    return {"r": tau, "p_value": p, "n": n}


# Pairs in and out of order

#: Rows of a bucket of the pair counts, and bounds at most: the table of bucket pairs that comes to the driver has at most (2 bounds + 1) squared cells.
PAIR_ROWS = 50_000
PAIR_BOUNDS = 1000


def _isolating_bounds(cells: DataFrame, column: str, rows: int) -> list:
    """Bounds about ``PAIR_ROWS`` rows apart, at most ``PAIR_BOUNDS``."""
    n = max(0, min(PAIR_BOUNDS, rows // PAIR_ROWS))
    if not n:
        return []
    shares = ", ".join(f"{k / (n + 1)}D" for k in range(1, n + 1))
    return sorted(set(cells.select(F.expr(f"percentile_approx({column}, array({shares}), {10 * (n + 1)})")).first()[0] or []))


def _isolated(df: DataFrame, column: str, bounds: list, name: str) -> DataFrame:
    """``df`` with ``name``, a bucket number that grows with ``column``: a value that is a bound has a bucket of its own, so that a bucket of two values
    or more is small."""
    held = df.sparkSession.createDataFrame([(bounds,)], f"_bounds array<{dict(df.dtypes)[column]}>")  # one row, at most PAIR_BOUNDS values
    v, steps = quoted(column), F.array(*[F.lit(1 << k) for k in reversed(range(PAIR_BOUNDS.bit_length()))])
    place = lambda test: F.aggregate(steps, F.lit(0), lambda at, step: F.when(test(F.get("_bounds", at + step - 1)), at + step).otherwise(at))
    return df.crossJoin(F.broadcast(held)).withColumn(name, place(lambda x: x < v) + place(lambda x: x <= v)).drop("_bounds")


def _pairs_by_order(p: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Sums of a_i b_j over pairs with p_i < p_j, apart by q_i below, equal to and above q_j.

    Pairs are met at the highest bit in which their ranks of p differ: at each bit rows stand by the bits above it and by q, and
    those with a 0 are summed up for those with a 1.
    """
    if len(p) < 2:
        return 0.0, 0.0, 0.0
    p, q = (np.unique(v, return_inverse=True)[1] for v in (p, q))
    a, b = a.astype(float), b.astype(float)
    order = np.argsort(q, kind="stable")
    p, q, a, b = p[order], q[order], a[order], b[order]
    below = equal = total = 0.0
    for bit in range(int(p.max()).bit_length()):
        group = p >> (bit + 1)
        own = np.argsort(group, kind="stable")
        g, qq, right = group[own], q[own], (p[own] >> bit & 1).astype(bool)
        left = np.where(right, 0.0, a[own])
        before = np.concatenate(([0.0], np.cumsum(left)))
        new_group = np.concatenate(([True], g[1:] != g[:-1]))
        new_run = new_group | np.concatenate(([True], qq[1:] != qq[:-1]))
        starts, runs = np.flatnonzero(new_group), np.flatnonzero(new_run)
        group_at, run_at = starts[np.cumsum(new_group) - 1], runs[np.cumsum(new_run) - 1]
        group_end = np.append(starts[1:], len(g))[np.cumsum(new_group) - 1]
        run_end = np.append(runs[1:], len(g))[np.cumsum(new_run) - 1]
        w = np.where(right, b[own], 0.0)
        below += float(w @ (before[run_at] - before[group_at]))
        equal += float(w @ (before[run_end] - before[run_at]))
        total += float(w @ (before[group_end] - before[group_at]))
    return below, equal, total - below - equal


def dominance_counts(cells: DataFrame) -> tuple[float, float, float]:
    """Sums of a_i b_j over pairs of rows with x_i < x_j, apart by y_i below, equal to and above y_j. cells: x, y, and weights a and b.

    Both columns are cut into range buckets. Pairs whose buckets differ in both are counted from the table of bucket pairs; pairs of
    one y bucket from counts by (x bucket, y), pairs of one x bucket from counts by (x, y bucket), and pairs of one bucket of both in that
    bucket. Buckets with a single value have no pairs of their own. No task gets more than about n / 1000 rows, or 50000.
    """
    rows = settled(cells.groupBy("x", "y").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "pair-cells")
    n = rows.count()
    placed = rows
    for column, name in (("x", "_u"), ("y", "_v")):
        placed = _isolated(placed, column, _isolating_bounds(rows, column, n), name)
    sums = (F.sum("a").alias("a"), F.sum("b").alias("b"))
    grid = placed.groupBy("_u", "_v").agg(*sums).toPandas()
    size = 2 * PAIR_BOUNDS + 2
    ga, gb = np.zeros((size, size)), np.zeros((size, size))
    ga[grid._u, grid._v], gb[grid._u, grid._v] = grid.a, grid.b
    from_left = np.vstack([np.zeros((1, size)), ga.cumsum(0)[:-1]])
    ahead = np.hstack([np.zeros((size, 1)), from_left.cumsum(1)[:, :-1]])
    behind = from_left.sum(1, keepdims=True) - from_left.cumsum(1)
    below, equal, above = float((gb * ahead).sum()), 0.0, float((gb * behind).sum())

    def local(key: list[str], p: str, q: str, with_equal: bool) -> None:
        nonlocal below, equal, above
        cells = placed.groupBy(*dict.fromkeys([*key, p, q])).agg(*sums)

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_pairs_by_order(*(frame[c].to_numpy() for c in (p, q, "a", "b")))], columns=["l", "e", "h"])

        r = cells.groupBy(*key).applyInPandas(count, "l double, e double, h double").agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("l", "e", "h")]).first()
        below, equal, above = below + r[0], equal + (r[1] if with_equal else 0.0), above + r[2]

    local(["_v"], "_u", "y", True)
    local(["_u"], "x", "_v", False)
    local(["_u", "_v"], "x", "y", True)
    return below, equal, above


def _corr_array(df: DataFrame, variables: list[str]) -> tuple[np.ndarray, int]:
    full = _num(df, *variables).dropna()
    pairs = list(itertools.combinations(range(len(variables)), 2))
    r = full.agg(F.count("*"), *[F.corr(variables[i], variables[j]) for i, j in pairs]).first()
    out = np.eye(len(variables))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = r[k + 1] if r[k + 1] is not None else math.nan
    return out, r[0]


def partial_correlation(df: DataFrame, x: str, y: str, covariates: list[str]) -> dict:
    c, n = _corr_array(df, [x, y, *covariates])
    inv = np.linalg.pinv(c)
    r = float(-inv[0, 1] / math.sqrt(inv[0, 0] * inv[1, 1]))
    df_ = n - 2 - len(covariates)
    z, half = math.atanh(max(-1 + 1e-15, min(1 - 1e-15, r))), 1.959963984540054 / math.sqrt(max(1, df_ - 1))
    return {"r": r, "p_value": _fisher_p(r, df_), "n": n, "ci_low": math.tanh(z - half), "ci_high": math.tanh(z + half)}


def correlation_matrix(df: DataFrame, variables: list[str], method: str = "fdr_bh") -> dict:
    c, n = _corr_array(df, variables)
    pairs = list(itertools.combinations(range(len(variables)), 2))
    p = [_fisher_p(c[i, j], n - 2) for i, j in pairs]
    adjusted = adjust_pvalues(p, method)["p_adjusted"]
    grid = lambda values: {(variables[i], variables[j]): v for (i, j), v in zip(pairs, values, strict=True)}
    return {"variables": variables, "r": c.tolist(), "p": grid(p), "p_adjusted": grid(adjusted), "n": n}


# Multiple tests


def adjust_pvalues(p: list[float], method: str = "fdr_bh", alpha: float = 0.05) -> dict:
    x = np.asarray(p, float)
    m, order = len(x), np.argsort(x, kind="stable")
    rank = np.arange(1, m + 1)
    s = x[order]
    if method == "bonferroni":
        adj = s * m
    elif method == "sidak":
        adj = 1 - (1 - s) ** m
    elif method == "holm":
        adj = np.maximum.accumulate(s * (m - rank + 1))
    elif method in ("fdr_bh", "fdr_by"):
        scale = (1 / rank).sum() if method == "fdr_by" else 1.0
        adj = np.minimum.accumulate((s * m * scale / rank)[::-1])[::-1]
    elif method == "fdr_tsbh":
        # The first stage stands where it rejects none or all; else what it did not reject is taken for the true hypotheses.
        adj = np.asarray(adjust_pvalues(s, "fdr_bh")["p_adjusted"])
        true = m - int((adj <= alpha).sum())
        adj = adj * true / m if 0 < true < m else adj
    else:
        raise ValueError(f"unknown method {method}")
    out = np.empty(m)
    out[order] = np.minimum(adj, 1.0)
    return {"p_adjusted": out.tolist(), "reject": (out <= alpha).tolist(), "method": method}


ADJUSTMENTS = ("bonferroni", "sidak", "holm", "fdr_bh", "fdr_by", "fdr_tsbh")


def adjust_column(df: DataFrame, p: str = "p", method: str = "fdr_bh", alpha: float = 0.05) -> DataFrame:
    """``df`` with p_adj, adjusted for as many tests as there are non-null p; a null p is no test and gets null.

    Equal p share a result, so distinct p are counted and ranked in range buckets; running extremes are taken in the buckets and, of
    a row a bucket, over them.
    """
    if method not in ADJUSTMENTS:
        raise ValueError(f"unknown method {method}")
    m = df.filter(quoted(p).isNotNull()).count()
    x = quoted(p).cast("double")
    if method == "bonferroni":
        return df.withColumn("p_adj", F.least(F.lit(1.0), x * m))
    if method == "sidak":
        return df.withColumn("p_adj", 1 - F.pow(1 - x, F.lit(float(m))))
    values = settled(average_ranks(df, p), "p-ranks")
    first, last = F.col("rank") - (F.col("ties") - 1) / 2, F.col("rank") + (F.col("ties") - 1) / 2
    step_down = method == "holm"
    scale = _harmonic(m) if method == "fdr_by" else 1.0
    values = with_buckets(values.withColumn("_q", x * (m - first + 1) if step_down else x * m * scale / last), p)
    # Holm: the greatest of what stands at this p or a smaller one; false discovery rates: the least at this p or a greater one.
    best = F.max if step_down else F.min
    order = (lambda c: quoted(c).asc()) if step_down else (lambda c: quoted(c).desc())
    over = Window.orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    ends = values.groupBy("_b").agg(best("_q").alias("_e")).select("_b", best("_e").over(over).alias("_e"))
    inside = Window.partitionBy("_b").orderBy(order(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extreme = F.greatest if step_down else F.least
    adjusted = values.join(F.broadcast(ends), "_b").select(quoted(p), "ties", F.least(F.lit(1.0), extreme(best("_q").over(inside), F.col("_e"))).alias("p_adj"))
    if method == "fdr_tsbh":
        adjusted = settled(adjusted, "p-adjusted")
        true = m - (adjusted.filter(F.col("p_adj") <= alpha).agg(F.sum("ties")).first()[0] or 0)
        if 0 < true < m:  # the first stage stands where it rejects none or all
            adjusted = adjusted.withColumn("p_adj", F.col("p_adj") * true / m)
    return df.join(adjusted.drop("ties"), p, "left").select(*[quoted(c) for c in df.columns], "p_adj")


def _harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m."""
    if m <= 1_000_000:
        return float((1 / np.arange(1, m + 1)).sum())
    return math.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m)


def benjamini_hochberg(df: DataFrame, p: str = "p", key: str = "feature") -> DataFrame:
    """``df`` with p_adj by Benjamini and Hochberg."""
    return adjust_column(df, p, "fdr_bh")


# Regress


def _gram(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int, float]:
    """X'X with an intercept, X'y, y'y, n and mean of y in one aggregate."""
    cols = [F.lit(1.0), *[quoted(c) for c in x]]
    pairs = list(itertools.combinations_with_replacement(range(len(cols)), 2))
    aggs = [F.sum(cols[i] * cols[j]) for i, j in pairs] + [F.sum(c * quoted(y)) for c in cols] + [F.sum(quoted(y) * quoted(y)), F.count("*")]
    r = df.agg(*aggs).first()
    a = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        a[i, j] = a[j, i] = r[k]
    b = np.array(r[len(pairs) : len(pairs) + len(cols)], float)
    return a, b, r[-2], r[-1], b[0] / r[-1]


def _standardised(df: DataFrame, x: list[str]) -> DataFrame:
    s = df.agg(*[F.avg(quoted(c)).alias(f"m{k}") for k, c in enumerate(x)], *[F.stddev_samp(quoted(c)).alias(f"s{k}") for k, c in enumerate(x)]).first()
    return df.withColumns({c: (quoted(c) - s[f"m{k}"]) / (s[f"s{k}"] or 1.0) for k, c in enumerate(x)})


def linear_regression(df: DataFrame, outcome: str, predictors: list[str], standardize: bool = False, order_by: str | None = None) -> dict:
    full = _num(df, outcome, *predictors, *([order_by] if order_by and order_by not in (outcome, *predictors) else [])).dropna()
    if standardize:
        full = _standardised(full, predictors)
    a, b, yy, n, mean = _gram(full, predictors, outcome)
    inv = np.linalg.pinv(a)
    beta = inv @ b
    rss, tss, k = yy - beta @ b, yy - n * mean**2, len(predictors)
    df_ = n - k - 1
    se = np.sqrt(np.maximum(0, np.diag(inv)) * rss / df_)
    t = beta / se
    crit = S.t_ppf(0.975, df_)
    r2 = 1 - rss / tss
    f = (tss - rss) / k / (rss / df_)
    corr = _corr_array(full, predictors)[0] if k > 1 else np.eye(1)
    fitted = sum((float(w) * quoted(c) for w, c in zip(beta[1:], predictors, strict=True)), F.lit(float(beta[0])))
    residuals = full.select("*", fitted.alias("fitted"), (quoted(outcome) - fitted).alias("residual"))
    dw = None
    if order_by:
        dw = durbin_watson(residuals, order_by)
    names = ["const", *predictors]
    return {"coefficients": {c: {"coef": float(beta[i]), "se": float(se[i]), "t": float(t[i]), "p_value": S.t_sf2(float(t[i]), df_), "ci_low": float(beta[i] - crit * se[i]), "ci_high": float(beta[i] + crit * se[i])} for i, c in enumerate(names)}, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_, "f_statistic": f, "f_p_value": S.f_sf(f, k, df_), "n": n, "vif": dict(zip(predictors, np.diag(np.linalg.pinv(corr)).tolist(), strict=True)), "durbin_watson": dw, "residuals": residuals}


def durbin_watson(df: DataFrame, order_by: str, residual: str = "residual") -> float:
    """Squared steps between neighbours over squares; neighbours are found in range buckets of the order, whose ends meet on
    the driver (a row a bucket)."""
    rows = df.select(quoted(order_by).alias("o"), quoted(residual).alias("r"), range_bucket(df, order_by).alias("b"))
    before = F.lag("r").over(Window.partitionBy("b").orderBy("o"))
    at = F.struct("o", "r")
    parts = rows.withColumn("s", F.pow(F.col("r") - before, F.lit(2))).groupBy("b").agg(F.sum("s").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.min(at).alias("f"), F.max(at).alias("l"))
    ends = sorted(parts.collect(), key=lambda x: x.b)
    steps = sum(x.s or 0.0 for x in ends) + sum((b.f.r - a.l.r) ** 2 for a, b in itertools.pairwise(ends))
    total = sum(x.q for x in ends)
    return steps / total if total else math.nan


def rank_auc(df: DataFrame, score: str, label: str, weight: str | None = None) -> float:
    """weight: a column of counts, where a row stands for several. The rows are read once; ranks come from their counts."""
    rows = df.select(quoted(score).alias("v"), quoted(label).alias("g"), (quoted(weight) if weight else F.lit(1)).alias("w"))
    cells = settled(rows.groupBy("v", "g").agg(F.sum("w").alias("n")), "auc")
    r = cells.join(average_ranks(cells, "v", weight="n"), "v")
    x = r.agg(F.sum(F.when(F.col("g") == 1, F.col("n") * F.col("rank"))).alias("r"), F.sum(F.when(F.col("g") == 1, F.col("n"))).alias("p"), F.sum("n").alias("n")).first()
    p, q = x.p or 0, x.n - (x.p or 0)
    return (x.r - p * (p + 1) / 2) / (p * q) if p and q else math.nan


def _exp(x: float) -> float:
    """e to the x; beyond what a double holds infinity, as for classes that a predictor separates."""
    return math.exp(x) if x < 709 else x if math.isnan(x) else math.inf


def logistic_regression(df: DataFrame, outcome: str, predictors: list[str], points: int = 100) -> dict:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    full = VectorAssembler(inputCols=predictors, outputCol="_x").transform(_num(df, outcome, *predictors).dropna())
    model = GeneralizedLinearRegression(family="binomial", featuresCol="_x", labelCol=outcome, predictionCol="_p", maxIter=100, tol=1e-10).fit(full)
    s = model.summary
    beta, se, z, p = [*model.coefficients, model.intercept], s.coefficientStandardErrors, s.tValues, s.pValues
    scored = model.transform(full)
    roc = roc_points(scored, "_p", outcome, points)
    out = {c: {"coef": b, "se": e, "z": t, "p_value": q, "odds_ratio": _exp(b), "or_low": _exp(b - 1.959963984540054 * e), "or_high": _exp(b + 1.959963984540054 * e)} for c, b, e, t, q in zip([*predictors, "const"], beta, se, z, p, strict=True)}
    return {"coefficients": out, "pseudo_r_squared": 1 - s.deviance / s.nullDeviance, "log_likelihood": -s.deviance / 2, "auc": rank_auc(scored, "_p", outcome), "roc": roc, "n": s.numInstances}


def roc_table(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, place): counts and rates of rows with at least each distinct score, the highest first. Rows without a score
    or a label do not count."""
    rows = df.select(quoted(score).cast("double").alias("threshold"), quoted(label).cast("int").alias("y")).dropna()
    cells = rows.groupBy("threshold").agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_q")).withColumn("_one", F.lit(1))
    p, q = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    table = running_sums(cells, "threshold", {"tp": "_p", "fp": "_q", "place": "_one"}, descending=True)
    return table.select("threshold", "tp", "fp", (F.col("tp") / F.lit(max(p, 1))).alias("tpr"), (F.col("fp") / F.lit(max(q, 1))).alias("fpr"), "place")


def roc_points(df: DataFrame, score: str, label: str, points: int = 100) -> list[tuple[float, float]]:
    """(fpr, tpr) from (0, 0) on: all points of the curve, or ``points`` of them at even places among the distinct scores."""
    table = settled(roc_table(df, score, label), "roc")
    n = table.count()
    places = sorted({int(x) for x in np.linspace(0, n, min(points, n + 1))} - {0})
    return [(0.0, 0.0), *[(r.fpr, r.tpr) for r in table.filter(F.col("place").isin(places)).orderBy("place").collect()]]  # ``points`` rows at most


def ancova(df: DataFrame, outcome: str, group: str, covariates: list[str]) -> list[dict]:
    """Type-II table: differences in residual sums of nested fits."""
    full = df.select(quoted(outcome).cast("double").alias(outcome), quoted(group).alias(group), *[quoted(c).cast("double").alias(c) for c in covariates]).dropna()
    levels = sorted(r[0] for r in full.select(group).distinct().collect())
    dummies = [f"_g{k}" for k in range(1, len(levels))]
    full = full.withColumns({d: (quoted(group) == v).cast("double") for d, v in zip(dummies, levels[1:], strict=True)})
    terms = {group: dummies} | {c: [c] for c in covariates}

    def rss(columns):
        a, b, yy, n, _ = _gram(full, columns, outcome)
        return yy - np.linalg.pinv(a) @ b @ b, n

    every = [c for cs in terms.values() for c in cs]
    own, n = rss(every)
    df_ = n - len(every) - 1
    out = []
    for term, columns in terms.items():
        ss = rss([c for c in every if c not in columns])[0] - own
        f = ss / len(columns) / (own / df_)
        out.append({"term": term, "sum_sq": float(ss), "df": len(columns), "F": float(f), "p_value": S.f_sf(float(f), len(columns), df_)})
    return [*out, {"term": "Residual", "sum_sq": float(own), "df": df_, "F": None, "p_value": None}]


# Longitudinal


def _mixed_sums(groups: DataFrame, p: int, q: int, d: np.ndarray, s2: float) -> list[np.ndarray]:
    """Sums over all groups that an EM step needs, from their cross products, in one aggregate: with w = (Z'Z + s2 D^-1)^-1, A = [Z'y, Z'X] and U = wA, of
    w, A'U, U x U, U'Z'ZU, tr(Z'Z w) and log det(I + Z'Z D / s2)."""
    size, at = p + q + 1, list(itertools.combinations_with_replacement(range(p + q + 1), 2))
    shapes = [(q, q), (p + 1, p + 1), (q, p + 1, q, p + 1), (p + 1, p + 1), (1,), (1,)]
    total = sum(math.prod(x) for x in shapes)

    def step(frames):
        for frame in frames:
            rows = frame.to_numpy(float)
            c = np.zeros((len(rows), size, size))
            for k, (i, j) in enumerate(at):
                c[:, i, j] = c[:, j, i] = rows[:, k]
            zz = c[:, p : p + q, p : p + q]
            a = np.concatenate([c[:, p : p + q, -1:], c[:, p : p + q, :p]], 2)
            w = np.linalg.inv(np.linalg.inv(d) * s2 + zz)
            u = w @ a
            parts = [w.sum(0), np.einsum("gia,gib->ab", a, u), np.einsum("gia,gjb->iajb", u, u), np.einsum("gia,gij,gjb->ab", u, zz, u), [np.einsum("gij,gji->", zz, w)], [np.linalg.slogdet(np.eye(q) + zz @ d / s2)[1].sum()]]
            yield pd.DataFrame([np.concatenate([np.ravel(x) for x in parts])], columns=[f"v{k}" for k in range(total)])

    made = groups.select(*[f"c{k}" for k in range(len(at))]).mapInPandas(step, ", ".join(f"v{k} double" for k in range(total)))
    flat = np.array(made.agg(*[F.sum(f"v{k}") for k in range(total)]).first(), float)
    ends = np.cumsum([math.prod(x) for x in shapes])
    return [flat[e - math.prod(x) : e].reshape(x) for e, x in zip(ends, shapes, strict=True)]


def linear_mixed_model(df: DataFrame, outcome: str, fixed: list[str], group: str, random_slopes: list[str] | None = None, iterations: int = 200) -> dict:
    """REML fit by EM. Each group's cross products are a row of a table; a step is one aggregate over it, whose sums are all that comes to
    the driver, whatever the number of groups."""
    slopes = random_slopes or []
    full = df.select(quoted(group).alias("_g"), *[quoted(c).cast("double").alias(c) for c in dict.fromkeys([outcome, *fixed, *slopes])]).dropna()
    xs, zs = [F.lit(1.0), *[quoted(c) for c in fixed]], [F.lit(1.0), *[quoted(c) for c in slopes]]
    p, q = len(xs), len(zs)
    every = [*xs, *zs, quoted(outcome)]
    pairs = list(itertools.combinations_with_replacement(range(len(every)), 2))
    groups = settled(full.groupBy("_g").agg(*[F.sum(every[i] * every[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)], F.count("*").alias("n")).drop("_g"), "group-products")
    m, n, *sums = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), *[F.sum(f"c{k}") for k in range(len(pairs))]).first()
    whole = np.zeros((len(every), len(every)))
    for k, (i, j) in enumerate(pairs):
        whole[i, j] = whole[j, i] = sums[k]
    xx, xy, yy = whole[:p, :p], whole[:p, -1], whole[-1, -1]
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    s2 = max(1e-8, float((yy - xy @ beta) / n))
    d = np.eye(q) * s2 / 2
    for _ in range(iterations):
        sum_w, h, k, big, trace_w, _ = _mixed_sums(groups, p, q, d, s2)
        precision = (xx - h[1:, 1:]) / s2
        cov = np.linalg.inv(precision)
        beta = cov @ (xy - h[1:, 0]) / s2
        theta = np.concatenate(([1.0], -beta))
        rest = yy - 2 * xy @ beta + beta @ xx @ beta
        fitted = theta @ h @ theta
        post = s2 * sum_w + np.einsum("iajc,ac->ij", k[:, 1:, :, 1:], cov)
        new_d = (np.einsum("a,iajc,c->ij", theta, k, theta) + post) / m
        trace = s2 * trace_w[0] + np.trace(cov @ big[1:, 1:]) + np.trace(xx @ cov) - 2 * np.trace(cov @ h[1:, 1:])
        new_s2 = float(rest - 2 * fitted + theta @ big @ theta + trace) / n
        done = np.abs(new_d - d).max() < 1e-10 and abs(new_s2 - s2) < 1e-10
        d, s2 = new_d, max(new_s2, 1e-12)
        if done:
            break
    det = float(_mixed_sums(groups, p, q, d, s2)[-1][0]) + n * math.log(s2)
    ll = -0.5 * ((n - p) * math.log(2 * math.pi) + det + np.linalg.slogdet(precision)[1] + (rest - fitted) / s2)
    k = p + q * (q + 1) // 2 + 1
    se = np.sqrt(np.diag(cov))
    coef = {c_: {"coef": float(b_), "se": float(e), "z": float(b_ / e), "p_value": 2 * S.normal_sf(abs(b_ / e)), "ci_low": float(b_ - 1.959963984540054 * e), "ci_high": float(b_ + 1.959963984540054 * e)} for c_, b_, e in zip(["Intercept", *fixed], beta, se, strict=True)}
    return {"coefficients": coef, "random_covariance": d.tolist(), "residual_variance": s2, "log_likelihood": float(ll), "aic": 2 * k - 2 * float(ll), "bic": k * math.log(n) - 2 * float(ll), "n_groups": m, "n_observations": n}


def change_from_baseline(df: DataFrame, subject: str, time: str, value: str, baseline=0) -> tuple[DataFrame, DataFrame]:
    """(rows with baseline, change and percent change; summary by later time). Subjects without a baseline stay, with nulls."""
    clean = df.select(quoted(subject).alias("subject"), quoted(time).alias("time"), quoted(value).cast("double").alias("value")).dropna()
    base = clean.filter(F.col("time") == F.lit(baseline)).groupBy("subject").agg(F.avg("value").alias("baseline"))
    rows = clean.join(base, "subject", "left").withColumn("change", F.col("value") - F.col("baseline")).withColumn("pct_change", safe_divide(100 * (F.col("value") - F.col("baseline")), F.col("baseline")))
    summary = rows.filter(F.col("time") != F.lit(baseline)).groupBy("time").agg(F.count("*").alias("n"), F.avg("change").alias("mean_change"), F.stddev_samp("change").alias("sd_change"), F.avg("pct_change").alias("mean_pct_change"))
    return rows, summary


# Survival


def risk_table(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """(group, t, d, n): events and numbers at risk at each distinct time; rows are aggregated to times first, and times summed in range buckets."""
    g = quoted(group).cast("string") if group else F.lit("all")
    rows = df.select(g.alias("group"), quoted(duration).cast("double").alias("t"), quoted(event).cast("int").alias("e")).dropna()
    times = rows.groupBy("group", "t").agg(F.sum("e").alias("d"), F.count("*").alias("c"))
    return running_sums(times, "t", {"n": "c"}, ["group"], descending=True).select("group", "t", "d", "n")


def kaplan_meier(df: DataFrame, duration: str, event: str, group: str | None = None) -> DataFrame:
    """(group, t, d, n, survival, ci_low, ci_high): log-log Greenwood intervals."""
    t, alive = risk_table(df, duration, event, group), F.col("d") < F.col("n")
    t = t.withColumns({"_log": F.when(alive, F.ln(1 - F.col("d") / F.col("n"))).otherwise(0.0), "_var": F.when(alive, F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))).otherwise(0.0), "_end": F.when(alive, 0).otherwise(1)})
    t = running_sums(t, "t", {"_ls": "_log", "_v": "_var", "_dead": "_end"}, ["group"])
    t = t.withColumn("survival", F.when(F.col("_dead") > 0, 0.0).otherwise(F.exp("_ls")))
    half = 1.959963984540054 * F.sqrt("_v") / F.when(F.col("_ls") != 0, F.abs("_ls"))
    return t.select("group", "t", "d", "n", "survival", F.when(F.col("survival") > 0, F.pow("survival", F.exp(half))).alias("ci_low"), F.when(F.col("survival") > 0, F.pow("survival", F.exp(-half))).alias("ci_high"))


def km_grid(df: DataFrame, duration: str, event: str, group: str | None = None, points: int = 100) -> dict:
    curves: dict = {}
    for r in settled(kaplan_meier(df, duration, event, group).filter("d > 0").select("group", "t", "survival"), "curves").toLocalIterator():  # a table: an iterator may outlive its query's shuffle files
        curves.setdefault(r.group, []).append((r.t, r.survival))
    top = df.agg(F.max(quoted(duration))).first()[0] or 0.0
    grid = np.linspace(0, float(top), points)
    out = {}
    for g, steps in sorted(curves.items()):
        t, s = np.array(sorted(steps)).T
        out[g] = {"time": grid.tolist(), "survival": np.concatenate(([1.0], s))[np.searchsorted(t, grid, "right")].tolist()}
    return out


def logrank_test(df: DataFrame, duration: str, event: str, group: str) -> dict:
    rows = df.select(quoted(group).cast("string").alias("g"), quoted(duration).cast("double").alias("t"), quoted(event).cast("int").alias("e")).dropna()
    groups = sorted(r.g for r in rows.select("g").distinct().collect())
    aggs = [F.sum("e").alias("d"), F.count("*").alias("c")]
    for k, g in enumerate(groups):
        aggs += [F.sum(F.when(F.col("g") == g, F.col("e")).otherwise(0)).alias(f"d{k}"), F.count_if(F.col("g") == g).alias(f"c{k}")]
    times = rows.groupBy("t").agg(*aggs)
    risk = running_sums(times, "t", {"n": "c"} | {f"n{k}": f"c{k}" for k in range(len(groups))}, descending=True).filter("d > 0")
    n = F.col("n").cast("double")
    spread = F.when(n > 1, F.col("d") * (n - F.col("d")) / (n - 1)).otherwise(0.0)
    k = len(groups) - 1
    sums = [F.sum(F.col(f"d{i}") - F.col("d") * F.col(f"n{i}") / n) for i in range(k)]
    covs = [F.sum(spread * (F.col(f"n{i}") / n) * ((1.0 if i == j else 0.0) - F.col(f"n{j}") / n)) for i in range(k) for j in range(k)]
    r = risk.agg(*sums, *covs).first()
    oe, v = np.array(r[:k], float), np.array(r[k:], float).reshape(k, k)
    stat = float(oe @ np.linalg.pinv(v) @ oe)
    return {"statistic": stat, "p_value": S.chi2_sf(stat, k), "df": k, "groups": groups}


def _cox_terms(p: int, beta: np.ndarray) -> list:
    """Weight of a row, and the weight times each covariate and each product of two."""
    w = F.exp(sum((float(b) * F.col(f"x{k}") for k, b in enumerate(beta)), F.lit(0.0)))
    return [w, *[w * F.col(f"x{k}") for k in range(p)], *[w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in itertools.combinations_with_replacement(range(p), 2)]]


def _cox_sums(rows: DataFrame, p: int, beta: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """What a Newton step and the test of proportional hazards need, summed over all death times, with Efron ties:
    log likelihood, gradient (p), information (p x p), and of ranks g of deaths: sums of g r (p), of g, and of g squared.

    Rows are summed to distinct times, times lie in range buckets. Sums of later buckets come from a row a bucket, those of later times
    in the bucket are added in its task.
    """
    terms = _cox_terms(p, beta)
    m, dead = len(terms), F.col("e") == 1
    risk = [F.sum(x).alias(f"r{k}") for k, x in enumerate(terms)]
    held = rows.groupBy("_b").agg(F.sum("e").alias("d"), *risk).orderBy("_b").toPandas()  # at most 2 PAIR_BOUNDS + 1 rows
    later = np.vstack([held[[f"r{k}" for k in range(m)]].to_numpy(float)[::-1].cumsum(0)[::-1][1:], np.zeros((1, m))])
    earlier = np.concatenate(([0.0], held.d.to_numpy(float).cumsum()[:-1]))
    offsets = {int(b): (later[k], earlier[k]) for k, b in enumerate(held._b)}
    times = rows.groupBy("_b", "t").agg(F.sum("e").alias("d"), *risk, *[F.sum(F.when(dead, x).otherwise(0.0)).alias(f"q{k}") for k, x in enumerate(terms)], *[F.sum(F.when(dead, F.col(f"x{k}")).otherwise(0.0)).alias(f"s{k}") for k in range(p)])
    at = list(itertools.combinations_with_replacement(range(p), 2))

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("t", ascending=False)
        after, before = offsets[int(f._b.iloc[0])]
        d = f.d.to_numpy(np.int64)
        whole = f[[f"r{k}" for k in range(m)]].to_numpy(float).cumsum(0) + after
        tied, s = f[[f"q{k}" for k in range(m)]].to_numpy(float), f[[f"s{k}" for k in range(p)]].to_numpy(float)
        rank = before + d[::-1].cumsum()[::-1] - d + (d + 1) / 2
        out = np.zeros(1 + p + p * p + p + 2)
        for row in np.flatnonzero(d):
            mean = np.zeros(p)
            for low in range(0, d[row], chunk):  # a death time with very many ties is one row and many terms
                share = np.arange(low, min(low + chunk, d[row])) / d[row]
                now = whole[row] - share[:, None] * tied[row]
                e1, h = now[:, 1 : p + 1] / now[:, :1], now[:, p + 1 :] / now[:, :1]
                mean += e1.sum(0)
                info = np.zeros((p, p))
                for k, (i, j) in enumerate(at):
                    info[i, j] = info[j, i] = h[:, k].sum()
                out[0] -= np.log(now[:, 0]).sum()
                out[1 + p : 1 + p + p * p] += (info - e1.T @ e1).ravel()
            out[0] += s[row] @ beta
            out[1 : 1 + p] += s[row] - mean
            out[1 + p + p * p : -2] += rank[row] * (s[row] - mean)
            out[-2:] += d[row] * np.array([rank[row], rank[row] ** 2])
        return pd.DataFrame([out], columns=[f"v{k}" for k in range(len(out))])

    size = 1 + p + p * p + p + 2
    parts = times.groupBy("_b").applyInPandas(step, ", ".join(f"v{k} double" for k in range(size)))
    return np.array(parts.agg(*[F.sum(f"v{k}") for k in range(size)]).first(), float)


def concordance(df: DataFrame, duration: str, event: str, risk: str) -> float:
    """Share of comparable pairs in which the subject with the higher risk dies first; equal risks count half.

    A pair is comparable if the earlier of the two times is a death; at equal times if just one of them is.
    """
    rows = settled(df.select(quoted(duration).cast("double").alias("t"), quoted(event).cast("bigint").alias("a"), quoted(risk).cast("double").alias("y")).dropna(), "concordance")
    # Twice the mid-ranks of different times are at least 2 apart: censored ones go right behind the deaths of their time.
    ranks = average_ranks(rows, "t").select("t", F.col("rank").alias("x"))
    cells = rows.join(ranks, "t").select((2 * F.col("x") + 1 - F.col("a")).alias("x"), "y", "a", F.lit(1).alias("b"))
    below, equal, above = dominance_counts(cells)
    total = below + equal + above
    return (above + equal / 2) / total if total else math.nan


def cox_regression(df: DataFrame, duration: str, event: str, covariates: list[str], iterations: int = 25) -> dict:
    """Newton's method with Efron ties, concordance, and a test of proportional hazards for each covariate.

    The test correlates scaled Schoenfeld residuals with mid-ranks of the death times. Sums over risk sets are made in range buckets of
    time, a row a bucket comes to the driver. Without convergence, as with separated groups, there are no coefficients.
    """
    p = len(covariates)
    rows = settled(df.select(quoted(duration).cast("double").alias("t"), quoted(event).cast("int").alias("e"), *[quoted(c).cast("double").alias(f"x{k}") for k, c in enumerate(covariates)]).dropna(), "cox-rows")
    n, deaths, *mean = rows.agg(F.count("*"), F.coalesce(F.sum("e"), F.lit(0)), *[F.avg(f"x{k}") for k in range(p)]).first()
    failed = {"coefficients": {}, "log_likelihood": None, "null_log_likelihood": None, "n": n, "n_events": deaths, "concordance": None, "ph_test": []}
    if not deaths:
        return failed
    rows = rows.withColumns({f"x{k}": F.col(f"x{k}") - mean[k] for k in range(p)})
    rows = settled(_isolated(rows, "t", _isolating_bounds(rows, "t", n), "_b"), "cox-buckets")
    beta, ll, ll0 = np.zeros(p), None, None
    try:
        for _ in range(iterations):
            found = _cox_sums(rows, p, beta)
            if not np.isfinite(found).all():
                return failed
            new, grad, info = found[0], found[1 : 1 + p], found[1 + p : 1 + p + p * p].reshape(p, p)
            ll0 = new if ll0 is None else ll0
            variance = np.linalg.inv(info)
            move = variance @ grad
            # Where classes are separated the likelihood settles while the coefficients go on.
            if ll is not None and abs(new - ll) < 1e-9 and np.abs(move).max() < 1e-3:
                break
            ll, beta = new, beta + move
        else:
            return failed
    except np.linalg.LinAlgError:
        return failed
    se = np.sqrt(np.diag(variance))
    g_r, g, g2 = found[1 + p + p * p : -2], found[-2], found[-1]
    spread = g2 - g * g / deaths
    scaled = deaths * variance @ (g_r - g / deaths * grad)
    with np.errstate(divide="ignore", invalid="ignore"):
        test = scaled**2 / (deaths * spread * se**2)
    tests = [{"predictor": c, "test_statistic": float(x), "p_value": S.chi2_sf(float(x), 1), "violates_ph": S.chi2_sf(float(x), 1) < 0.05} for c, x in zip(covariates, test, strict=True) if math.isfinite(x)]
    risk = sum((float(b) * F.col(f"x{k}") for k, b in enumerate(beta)), F.lit(0.0))
    coef = {c: {"coef": float(b), "hazard_ratio": math.exp(b), "se": float(e), "z": float(b / e), "p_value": 2 * S.normal_sf(abs(b / e)), "hr_low": math.exp(b - 1.959963984540054 * e), "hr_high": math.exp(b + 1.959963984540054 * e)} for c, b, e in zip(covariates, beta, se, strict=True)}
    return {"coefficients": coef, "log_likelihood": float(new), "null_log_likelihood": float(ll0), "n": n, "n_events": deaths, "concordance": concordance(rows.withColumn("_risk", risk), "t", "e", "_risk"), "ph_test": tests}
