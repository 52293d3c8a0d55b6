"""Nearest neighbours against comparing everything; small leaves, so that the tree has levels; ties, copies, few rows."""

import numpy as np
import pandas as pd
import pytest

from cohortloom.operators import neighbours as N


def plain(q, r, k, other):
    out = set()
    for i, x in enumerate(q):
        d2 = ((r - x) ** 2).sum(1)
        order = sorted((v, j) for j, v in enumerate(d2) if not (other and i == j))[:k]
        out |= {(i, j, place + 1) for place, (v, j) in enumerate(order)}
    return out


def frame(spark, points, key="id"):
    pdf = pd.DataFrame(points, columns=[f"c{j}" for j in range(points.shape[1])])
    pdf[key] = range(len(points))
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "line", "few"])
def test_nearest(spark, kind):
    r = np.random.default_rng(1)
    points = {"spread": r.normal(size=(1500, 3)), "grid": r.integers(0, 6, (900, 2)).astype(float), "copies": np.vstack([np.zeros((500, 2)), r.exponential(size=(400, 2))]), "line": np.column_stack([np.zeros(800), 2.0 ** -r.integers(0, 40, 800)]), "few": r.normal(size=(3, 2))}[kind]
    cols, k = [f"c{j}" for j in range(points.shape[1])], 4
    df = frame(spark, points)
    tree = N.box_tree(df, "id", cols, k, leaf=1)
    if kind == "spread":
        assert tree.kids.count() > 1
    found = {(x.q, x.r, x.place) for x in N.nearest(tree, df.filter("id < 200"), "id", cols, other=True).collect()}
    assert found == {x for x in plain(points[:200], points, k, True)}
    away = np.array([[9.0] * points.shape[1], [-50.0] * points.shape[1]])
    found = {(x.q, x.r, x.place) for x in N.nearest(tree, frame(spark, away), "id", cols, k=2).collect()}
    assert found == plain(away, points, 2, False)


def test_empty_and_gaps(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 3.0), (2, 2.0, 3.0)], "id long, a double, b double")
    tree = N.box_tree(df, "id", ["a", "b"], 3)
    assert [(x.q, x.r) for x in N.nearest(tree, df, "id", ["a", "b"], other=True).orderBy("q").collect()] == [(1, 2), (2, 1)]
    assert N.nearest(tree, df.limit(0), "id", ["a", "b"]).count() == 0
    assert N.nearest(N.box_tree(df.limit(0), "id", ["a", "b"], 3), df, "id", ["a", "b"]).count() == 0


def zscore(x):
    return (x - x.mean(0)) / x.std(0)


def labelled(n=120, m=25, seed=2):
    r = np.random.default_rng(seed)
    return np.vstack([r.normal(0, 1, (n, 2)), r.normal(1.5, 1, (m, 2))]), np.array([0] * n + [1] * m)


def as_frame(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y, "id": range(len(y))}))


def neighbours_of(x, k):
    z = zscore(x)
    return [[j for _, j in sorted((((z[j] - z[i]) ** 2).sum(), j) for j in range(len(z)) if j != i)[:k]] for i in range(len(z))]


def test_impute(spark):
    x, _ = labelled()
    df = as_frame(spark, x, np.zeros(len(x))).selectExpr("id", "a", "if(id % 9 = 4, null, b) as b")
    gaps = np.arange(len(x)) % 9 == 4
    b = np.where(gaps, np.nan, x[:, 1])
    za, zb = zscore(x[:, :1])[:, 0], np.where(gaps, 0.0, (b - np.nanmean(b)) / np.nanstd(b))
    got = {r.id: r.b for r in N.impute_nearest(df, ["a", "b"], k=3).collect()}
    for i in np.flatnonzero(gaps):
        near = sorted(((za[j] - za[i]) ** 2 + (zb[j] - zb[i]) ** 2, j) for j in np.flatnonzero(~gaps))[:3]
        assert got[i] == pytest.approx(np.mean([b[j] for _, j in near]))
    assert all(got[i] == b[i] for i in np.flatnonzero(~gaps))


def on_segment(p, x, own, near):
    """Whether p lies between a row of ``own`` and one of its neighbours."""
    for i in own:
        for j in near[i]:
            d = x[j] - x[i]
            t = ((p - x[i]) @ d) / (d @ d)
            if -1e-9 <= t <= 1 + 1e-9 and np.allclose(x[i] + t * d, p, atol=1e-9):
                return i
    return None


def test_smote_and_adasyn(spark):
    x, y = labelled()
    df, own = as_frame(spark, x, y), list(np.flatnonzero(y == 1))
    z = zscore(x)
    near = {i: [j for _, j in sorted((((z[j] - z[i]) ** 2).sum(), j) for j in own if j != i)[:5]] for i in own}
    out = N.oversample(df, "y", ["a", "b"], "smote").toPandas()
    assert (out.y == 1).sum() == (out.y == 0).sum() == 120
    made = out.iloc[len(x) :]
    starts = [on_segment(p, x, own, near) for p in made[["a", "b"]].to_numpy()]
    assert None not in starts and len(made) == 95
    around = neighbours_of(x, 5)
    hard = np.array([np.mean([y[j] != 1 for j in around[i]]) for i in own])
    want = np.round(hard / hard.sum() * 95).astype(int)  # numpy rounds halves to even, too
    out = N.oversample(df, "y", ["a", "b"], "adasyn").toPandas()
    assert len(out) == len(x) + want.sum()
    per = out.iloc[len(x) :].groupby("id").size().to_dict()
    assert per == {i: n for i, n in zip(own, want, strict=True) if n}


def test_edited_and_tomek(spark):
    x, y = labelled()
    df = as_frame(spark, x, y)
    near = neighbours_of(x, 3)
    want = {i for i in range(len(y)) if all(y[j] == y[i] for j in near[i])}
    assert {r.id for r in N.edited(df, "y", ["a", "b"]).collect()} == want
    one = [v[0] for v in near]
    linked = {i for i in range(len(y)) if one[one[i]] == i and y[one[i]] != y[i]}
    assert linked and {r.id for r in N.without_tomek_links(df, "y", ["a", "b"]).collect()} == set(range(len(y))) - linked


def test_vote_and_relief(spark):
    x, y = labelled()
    r = np.random.default_rng(3)
    fresh = r.normal(0.7, 1, (40, 2))
    got = {v.id: (v.prediction, v.share) for v in N.vote(as_frame(spark, x, y), as_frame(spark, fresh, np.zeros(40)).drop("y"), "y", ["a", "b"], 5).collect()}
    z, q = zscore(x), (fresh - x.mean(0)) / x.std(0)
    for i in range(40):
        near = [j for _, j in sorted((((z[j] - q[i]) ** 2).sum(), j) for j in range(len(z)))[:5]]
        ones = sum(y[j] for j in near)
        assert got[i] == (int(ones > 2), max(ones, 5 - ones) / 5)
    s = (x - x.min(0)) / (x.max(0) - x.min(0))
    want = np.zeros(2)
    for i in range(len(y)):
        d = ((s - s[i]) ** 2).sum(1)
        hit = min((d[j], j) for j in range(len(y)) if j != i and y[j] == y[i])[1]
        miss = min((d[j], j) for j in range(len(y)) if y[j] != y[i])[1]
        want += np.abs(s[i] - s[miss]) - np.abs(s[i] - s[hit])
    assert N.relief_scores(as_frame(spark, x, y), "y", ["a", "b"]) == pytest.approx(want.tolist())
