"""Fitted powers and curves, against plain versions."""

import numpy as np
import pandas as pd
import pytest

from cohortloom.model import LEAKAGE_FEATURES
from cohortloom.operators import features, reduce, stats


def likelihood(x, lam, yeo_johnson):
    box = lambda v, p: np.log(v) if abs(p) < 1e-12 else (v**p - 1) / p
    if yeo_johnson:
        y = np.where(x >= 0, box(np.abs(x) + 1, lam), -box(np.abs(x) + 1, 2 - lam))
        j = (np.sign(x) * np.log(np.abs(x) + 1)).sum()
    else:
        logs = np.log(x) - np.log(x).mean()  # powers of x over its geometric mean
        y, j = logs if abs(lam) < 1e-12 else np.exp(lam * logs) / lam, 0.0
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * j


@pytest.mark.parametrize("kind", ["lognormal", "steep", "two-sided"])
def test_fitted_lambda(spark, kind):
    r = np.random.default_rng(11)
    x = {"lognormal": np.exp(r.normal(size=400)), "steep": 10 + r.normal(size=400) ** 2 * 0.1, "two-sided": r.normal(size=400) ** 3}[kind]
    yj = kind == "two-sided"
    got = features.box_cox_lambda(spark.createDataFrame(pd.DataFrame({"x": x})), "x", yj)
    grid = np.arange(got - 0.01, got + 0.01, 1e-5)
    assert abs(grid[np.argmax([likelihood(x, g, yj) for g in grid])] - got) <= 1e-4
    wide = np.arange(-60, 20, 0.5)
    with np.errstate(all="ignore"):
        assert likelihood(x, got, yj) >= np.nanmax([likelihood(x, g, yj) for g in wide])


def test_no_lambda(spark):
    df = spark.createDataFrame([(1.0, -1.0, None)] * 3, "one double, negative double, none double")
    assert features.box_cox_lambda(df, "one") is None and features.box_cox_lambda(df, "negative") is None and features.box_cox_lambda(df, "none", True) is None


def test_curve_points(spark):
    r = np.random.default_rng(12)
    s, y = np.round(r.random(300), 2), r.integers(0, 2, 300)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    want = [(0.0, 0.0)] + [(float(((s >= t) & (y == 0)).sum() / (y == 0).sum()), float(((s >= t) & (y == 1)).sum() / (y == 1).sum())) for t in sorted(set(s), reverse=True)]
    assert stats.roc_points(df, "s", "y", 1000) == [pytest.approx(v) for v in want]
    few = stats.roc_points(df, "s", "y", 10)
    assert len(few) == 10 and few[0] == (0.0, 0.0) and few[-1] == (1.0, 1.0)
    assert stats.roc_points(df.limit(0), "s", "y") == [(0.0, 0.0)]


def test_known_leakage(spark):
    assert len(LEAKAGE_FEATURES) == len(set(LEAKAGE_FEATURES)) == 57
    df = spark.createDataFrame([(1, 2, 3)], "motor_assessments_PDMEDYN int, age int, COHORT int")
    assert reduce.drop_leakage(df, list(LEAKAGE_FEATURES)).columns == ["age", "COHORT"]
