"""Pairs in and out of order, Kendall, concordance, Cox regression and its test, against plain loops; buckets are made small so that there are many."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from cohortloom.functions import scalar, special
from cohortloom.operators import stats


@pytest.fixture(params=["one bucket", "many buckets"])
def buckets(request, monkeypatch):
    if request.param == "many buckets":
        monkeypatch.setattr(stats, "PAIR_ROWS", 25)
        monkeypatch.setattr(scalar.with_buckets, "__defaults__", (None, 20))


def plain_counts(x, y, a, b):
    out = [0, 0, 0]
    for i, j in itertools.permutations(range(len(x)), 2):
        if x[i] < x[j]:
            out[0 if y[i] < y[j] else 1 if y[i] == y[j] else 2] += a[i] * b[j]
    return tuple(out)


@pytest.mark.parametrize("kind", ["ties", "hot", "line", "constant"])
def test_dominance(spark, buckets, kind):
    r = np.random.default_rng(3)
    n = 250
    x, y = r.integers(0, 40, n).astype(float), r.integers(0, 30, n).astype(float)
    if kind == "hot":
        x, y = np.where(r.random(n) < 0.4, 7.0, x), np.where(r.random(n) < 0.5, 9.0, y)
    if kind == "line":
        x = r.normal(size=n)
        y = x + r.normal(size=n) * 0.05
    if kind == "constant":
        x = np.ones(n)
    a, b = r.integers(0, 3, n), r.integers(1, 4, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "a": a, "b": b}))
    assert stats.dominance_counts(df) == plain_counts(x, y, a, b)


def test_kendall(spark, buckets):
    # Published example: 12 judges' ranks with one tie give tau-b and its p by hand.
    x, y = [12, 2, 1, 12, 2], [1, 4, 7, 1, 0]
    r = stats.correlate_pair(spark.createDataFrame(list(zip(map(float, x), map(float, y), strict=True)), "x double, y double"), "x", "y", "kendall")
    assert r["r"] == pytest.approx(-0.47140452, abs=1e-8) and r["p_value"] == pytest.approx(0.2827454599, abs=1e-8)
    z = [(float(k), float(v)) for k, v in enumerate([0, 2, 1, 3, 5, 4])]
    exact = stats.correlate_pair(spark.createDataFrame(z, "x double, y double"), "x", "y", "kendall")
    orders = list(itertools.permutations(range(6)))
    out = [sum(p[i] > p[j] for i in range(6) for j in range(i + 1, 6)) for p in orders]
    assert exact["p_value"] == pytest.approx(2 * sum(v <= 2 for v in out) / len(orders)) and exact["r"] == pytest.approx(1 - 2 * 2 / 15)
    assert math.isnan(stats.correlate_pair(spark.createDataFrame([(1.0, float(k)) for k in range(5)], "x double, y double"), "x", "y", "kendall")["r"])


def survival(seed, n=160):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 2, n)])
    t = np.ceil(r.exponential(8 * np.exp(-x @ [0.5, 0.8])) * 2) / 2
    e = (r.random(n) < 0.7).astype(int)
    return t, e, x


def plain_cox(t, e, x):
    """Efron's likelihood by a loop over deaths; Newton; residual sums."""
    x = x - x.mean(0)
    p, beta = x.shape[1], np.zeros(x.shape[1])
    for _ in range(30):
        grad, info, ll, resid, ranks = np.zeros(p), np.zeros((p, p)), 0.0, [], []
        w, done = np.exp(x @ beta), 0
        for u in sorted(set(t[e == 1])):
            risk, dead = t >= u, (t == u) & (e == 1)
            d, mean = dead.sum(), np.zeros(p)
            for k in range(d):
                s0, s1 = w[risk].sum() - k / d * w[dead].sum(), (w[:, None] * x)[risk].sum(0) - k / d * (w[:, None] * x)[dead].sum(0)
                s2 = np.einsum("n,ni,nj->ij", w[risk], x[risk], x[risk]) - k / d * np.einsum("n,ni,nj->ij", w[dead], x[dead], x[dead])
                ll -= math.log(s0)
                info += s2 / s0 - np.outer(s1, s1) / s0**2
                mean += s1 / s0 / d
            ll += (x[dead] @ beta).sum()
            grad += (x[dead] - mean).sum(0)
            resid += list(x[dead] - mean)
            ranks += [done + (d + 1) / 2] * d
            done += d
        beta = beta + np.linalg.solve(info, grad)
    v, resid, g = np.linalg.inv(info), np.array(resid), np.array(ranks)
    g = g - g.mean()
    scaled = len(g) * resid @ v
    return beta, np.sqrt(np.diag(v)), ll, (g @ scaled) ** 2 / (len(g) * (g**2).sum() * np.diag(v))


def plain_concordance(t, e, risk):
    good = total = 0.0
    for i, j in itertools.permutations(range(len(t)), 2):
        if e[i] and (t[i] < t[j] or (t[i] == t[j] and not e[j])):
            total += 1
            good += 1.0 if risk[i] > risk[j] else 0.5 if risk[i] == risk[j] else 0.0
    return good / total


def test_cox(spark, buckets):
    t, e, x = survival(1)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "a": x[:, 0], "b": x[:, 1]}))
    got = stats.cox_regression(df, "t", "e", ["a", "b"])
    beta, se, ll, test = plain_cox(t, e, x)
    assert [got["coefficients"][c]["coef"] for c in "ab"] == pytest.approx(beta.tolist(), abs=1e-6)
    assert [got["coefficients"][c]["se"] for c in "ab"] == pytest.approx(se.tolist(), abs=1e-6)
    assert got["log_likelihood"] == pytest.approx(ll) and [r["test_statistic"] for r in got["ph_test"]] == pytest.approx(test.tolist(), rel=1e-5)
    assert [r["p_value"] for r in got["ph_test"]] == pytest.approx([special.chi2_sf(v, 1) for v in test])
    assert got["concordance"] == pytest.approx(plain_concordance(t, e, x @ beta)) and got["n_events"] == e.sum()


def test_cox_degenerate(spark):
    separated = spark.createDataFrame([(float(k), 1, 1.0 if k < 10 else 0.0) for k in range(20)], "t double, e int, x double")
    assert stats.cox_regression(separated, "t", "e", ["x"])["coefficients"] == {}
    assert stats.cox_regression(separated.withColumn("e", separated.e * 0), "t", "e", ["x"])["coefficients"] == {}
    assert stats.cox_regression(separated.limit(0), "t", "e", ["x"])["n"] == 0
    constant = separated.selectExpr("t", "e", "1.0D as x")
    assert stats.cox_regression(constant, "t", "e", ["x"])["coefficients"] == {}


def test_running_sums_and_survival_tables(spark, buckets):
    t, e, x = survival(4)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "g": np.where(x[:, 1] > 0, "u", "v")}))
    got = {(r.group, r.t): r for r in stats.kaplan_meier(df, "t", "e", "g").collect()}
    for g in "uv":
        own, s = (x[:, 1] > 0) == (g == "u"), 1.0
        for u in sorted(set(t[own])):
            n, d = (t[own] >= u).sum(), ((t[own] == u) & (e[own] == 1)).sum()
            s *= 1 - d / n
            assert (got[g, u].n, got[g, u].d) == (n, d) and got[g, u].survival == pytest.approx(s, abs=1e-9)


@pytest.mark.parametrize("method", stats.ADJUSTMENTS)
def test_adjustments(spark, buckets, method):
    r = np.random.default_rng(2)
    for p in ([0.001, 0.002, 0.003], [0.5, 0.6], list(np.round(r.random(120) ** 3, 3)), [0.01, 0.04, 0.03, 0.005]):
        df = spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double")
        got = sorted(x.p_adj for x in stats.adjust_column(df, "p", method).collect() if x.p is not None)
        assert got == pytest.approx(sorted(stats.adjust_pvalues(p, method)["p_adjusted"]))
    assert stats.adjust_pvalues([0.001, 0.002, 0.003], "fdr_tsbh")["p_adjusted"] == pytest.approx([0.003, 0.003, 0.003])
    # Two of four rejected at first: the others are taken for the true hypotheses, so values halve.
    two = stats.adjust_pvalues([0.001, 0.002, 0.6, 0.8], "fdr_tsbh")
    assert two["p_adjusted"] == pytest.approx([0.002, 0.002, 0.4, 0.4]) and two["reject"] == [True, True, False, False]


def test_exact_quantiles_of_many_rows(spark):
    """Groups beyond the size that is counted whole, with ties and a group of one value."""
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": r.choice(["a", "b", "c"], 30_000, p=[0.7, 0.2, 0.1])})
    pdf["v"] = np.where(pdf.g == "c", 3.0, np.where(r.random(30_000) < 0.4, 1.5, r.normal(size=30_000)))
    shares = {"q0": 0.0, "q1": 0.01, "q25": 0.25, "q5": 0.5, "q999": 0.999, "q100": 1.0}
    got = scalar.exact_quantiles(spark.createDataFrame(pdf), "v", shares, ["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").v.quantile(list(shares.values())).unstack().sort_index()
    assert np.allclose(got[list(shares)].to_numpy(), want.to_numpy(), atol=1e-12)
    assert np.allclose(scalar.exact_quantiles(spark.createDataFrame(pdf), "v", shares).toPandas().to_numpy()[0], pdf.v.quantile(list(shares.values())))
