"""The cohort engine: goldens, invariants and the pipeline from raw tables to a model."""

import math
import random

import duckdb
import numpy as np
import pytest

from cohortloom.functions import cleaners, scalar, special
from cohortloom.model import ReducerConfig, Study
from cohortloom.operators import clinical, features, ml, reduce, select, stats
from cohortloom.plans import catalogue_rules as catalogue
from cohortloom.plans import pipeline
from cohortloom.sources import io

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5))
    return str(a)[:19] == str(b)[:19]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(catalogue.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    key = lambda r: tuple(f"{x:.3f}" if isinstance(x, float) else str(x)[:19] for x in r)
    want = sorted(([r[k] if not hasattr(r[k], "as_tuple") else float(r[k]) for k in at] for r in cur.fetchall()), key=key)
    df = catalogue.queries()[name](spark, sf)
    assert sorted(df.columns) == names
    got = sorted(([r[n] for n in names] for r in df.collect()), key=key)
    assert len(got) == len(want) and all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


def groups(spark, **values):
    return spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")


def test_goldens(spark):
    out = stats.adjust_pvalues([0.01, 0.04, 0.03, 0.005], "bonferroni")
    assert np.allclose(out["p_adjusted"], [0.04, 0.16, 0.12, 0.02]) and out["reject"][3]
    with pytest.raises(ValueError):
        stats.adjust_pvalues([0.1], "x")
    doses = spark.createDataFrame([("levodopa_ir", 300.0), ("pramipexole", 4.0)], "drug string, dose double")
    assert clinical.compute_ledd(doses)[0].first().total_ledd == 700
    total, rows = clinical.compute_ledd(spark.createDataFrame([("levodopa_ir", 300.0), ("new", 4.0)], "drug string, dose double"))
    assert total.first().total_ledd == 300 and rows.filter("note is not null").count() == 1
    items = spark.createDataFrame([(1, 1, 1, 2, 3, 0), (1, 0, 1, 1, 2, 2)], "a int, b int, c int, d int, e int, f int")
    u = clinical.aggregate_updrs(items, ["a", "b"], ["c"], ["d", "e"], ["f"]).collect()
    assert [r.updrs_total for r in u] == [8, 7] and [r.updrs_motor for r in u] == [5, 3]
    hy = clinical.hoehn_yahr_summary(spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 3, 3, 4, 5)], "s double"), "s")
    assert {r.stage: (r["count"], r.median) for r in hy.collect()}[3.0] == (3, 3.0)


def test_p_values_against_tables():
    assert special.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert special.studentized_range_ppf(0.95, 3, 20) == pytest.approx(3.578, abs=2e-3)
    assert special.hypergeom_two_sided(1, 9, 11, 3) == pytest.approx(0.002759, abs=1e-5)
    assert stats.mcnemar(3, 15)["p_value"] < 0.05
    w, p = special.shapiro_wilk(sorted([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)


def test_compare(spark):
    r = np.random.default_rng(0)
    two = groups(spark, a=r.normal(10, 2, 50), b=r.normal(12, 2, 50))
    t = stats.independent_ttest(two, "v", "g")
    assert t["p_value"] < 0.001 and t["statistic"] < 0 and t["df"] == 98
    assert t["hedges_g"] == pytest.approx(t["cohens_d"] * (1 - 3 / (4 * 100 - 9)))
    assert stats.mann_whitney(two, "v", "g")["p_value"] < 0.001
    small = stats.mann_whitney(groups(spark, a=[1, 2, 3], b=[4, 5, 6, 7]), "v", "g")
    assert small["statistic"] == 0 and small["p_value"] == pytest.approx(2 / 35)
    assert math.isnan(stats.cohens_d(groups(spark, a=[0.0] * 30, b=[1.0] * 30), "v", "g"))
    three = groups(spark, a=r.normal(0, 1, 30), b=r.normal(3, 1, 30), c=r.normal(5, 1, 30))
    assert stats.one_way_anova(three, "v", "g")["p_value"] < 0.001 and len(stats.tukey_hsd(three, "v", "g")) == len(stats.dunn_posthoc(three, "v", "g")) == 3
    assert stats.chi_square([[10, 20], [30, 15]])["dof"] == 1
    with pytest.raises(ValueError):
        stats.fisher_exact([[1, 2, 3], [4, 5, 6]])
    pairs = spark.createDataFrame([(float(x), float(x + d)) for x, d in zip(r.normal(0, 1, 30), r.normal(0.8, 0.5, 30), strict=True)], "a double, b double")
    assert stats.wilcoxon_signed_rank(pairs, "a", "b")["p_value"] < 0.05
    assert stats.normality_test(two, "v")["p_value"] > 0.001 and stats.normality_test(two, "v", "ks")["n"] == 100


def test_correlate_and_regress(spark):
    r = np.random.default_rng(0)
    age, dd = r.normal(65, 10, 200), r.normal(10, 3, 200)
    rows = [(float(a), float(d), float(1 + 0.5 * a + 2 * d + e), int(a > 65), "A" if k % 2 else "B", k) for k, (a, d, e) in enumerate(zip(age, dd, r.normal(0, 2, 200), strict=True))]
    df = spark.createDataFrame(rows, "age double, dd double, y double, old int, grp string, k int")
    fit = stats.linear_regression(df, "y", ["age", "dd"], order_by="k")
    assert fit["coefficients"]["age"]["coef"] == pytest.approx(0.5, abs=0.05) and fit["coefficients"]["dd"]["coef"] == pytest.approx(2, abs=0.15) and fit["r_squared"] > 0.9 and 1.5 < fit["durbin_watson"] < 2.5
    assert stats.correlate_pair(df, "age", "y")["r"] > 0.5 and stats.partial_correlation(df, "age", "y", ["dd"])["r"] > 0.8
    tau = stats.correlate_pair(df, "age", "y", "kendall")["r"]
    x, y = [q[0] for q in rows], [q[2] for q in rows]
    score = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(200) for j in range(i))
    assert tau == pytest.approx(score / (200 * 199 / 2))
    assert stats.logistic_regression(df, "old", ["dd"])["n"] == 200
    assert [t["term"] for t in stats.ancova(df, "y", "grp", ["age"])] == ["grp", "age", "Residual"]
    assert stats.correlation_matrix(df, ["age", "dd", "y"])["r"][0][0] == 1.0
    assert stats.missingness_report(df)["chi2"] == 0


def test_longitudinal_and_survival(spark):
    r = np.random.default_rng(1)
    rows = [(s, v, float(b + 2 * v + r.normal())) for s, b in enumerate(r.normal(20, 5, 30)) for v in range(4)]
    m = stats.linear_mixed_model(spark.createDataFrame(rows, "p int, v int, y double"), "y", ["v"], "p")
    assert m["coefficients"]["v"]["coef"] == pytest.approx(2, abs=0.3) and m["n_groups"] == 30 and m["n_observations"] == 120
    _, s = stats.change_from_baseline(spark.createDataFrame(rows, "p int, v int, y double"), "p", "v", "y")
    assert {x.time: x.mean_change for x in s.collect()}[3] == pytest.approx(6, abs=0.7)
    t = [(float(min(40, r.exponential(20 if g == 0 else 6.67))), g) for g in (0, 1) for _ in range(150)]
    surv = spark.createDataFrame([(a, int(a < 40), g) for a, g in t], "t double, e int, g int")
    assert stats.logrank_test(surv, "t", "e", "g")["p_value"] < 1e-5
    cox = stats.cox_regression(surv, "t", "e", ["g"])["coefficients"]["g"]
    assert 2 < cox["hazard_ratio"] < 5
    grid = stats.km_grid(surv, "t", "e", "g")
    assert set(grid) == {"0", "1"} and all(a >= b for x in grid.values() for a, b in zip(x["survival"], x["survival"][1:], strict=False))


def study_rows(spark, n=240):
    r = random.Random(3)
    base, motor = [], []
    for k in range(n):
        pd = k % 2
        base.append((k, "BL", "PD" if pd else "control ", "c", r.gauss(60, 9), f"site{k % 3}", "rec"))
        motor.append((k, "BL", r.gauss(30 if pd else 8, 4), None if k % 97 else 1.0, f"{r.randrange(5)}|{r.randrange(5)}"))
        if k % 10 == 0:
            motor.append((k, "BL", None, 2.0, None))
    return Study.of({
        "subject_characteristics": spark.createDataFrame(base, "PATNO int, EVENT_ID string, COHORT string, const string, AGE double, SITE string, REC_ID string"),
        "motor_assessments": spark.createDataFrame(motor, "PATNO int, EVENT_ID string, NP3TOT double, empty double, pipes string"),
        "other": spark.createDataFrame([(1,)], "x int"),
    })


def test_reduce(spark):
    study = study_rows(spark)
    drops = reduce.analyze(study)
    assert drops["subject_characteristics"] == {"REC_ID": "single_value", "const": "single_value"}
    slim = reduce.apply_drops(study, drops)
    wide = reduce.consolidate_cohort(reduce.merge_study(slim))
    assert wide.count() == 240 == wide.select("PATNO", "EVENT_ID").distinct().count()
    assert {r[0] for r in wide.select("COHORT").distinct().collect()} == {"Parkinson's Disease", "Healthy Control"}
    assert ReducerConfig().override(missing_threshold=0.1).missing_threshold == 0.1
    assert "columns to drop" in reduce.report_text(drops)


def test_pipeline_end_to_end(spark, tmp_path):
    out = str(tmp_path / "out")
    done = pipeline.run_pipeline("", out, study=study_rows(spark), include=["lr", "dt"], n_models=1)
    assert done["classification"]["test"]["Accuracy"] > 0.9 and "motor_assessments_NP3TOT" in done["selection"]["selected"]
    for name in ("data_reduction_report.html", "feature_engineering_report.html", "feature_selection_report.html", "pipeline_report.html", "classification/classification_report.html"):
        assert (tmp_path / "out" / name).exists()
    again = pipeline.run_pipeline("", out, skip_to="classification", include=["dt"], n_models=1)
    assert list(again) == ["classification"]
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline("", str(tmp_path / "none"), skip_to="selection")


def test_features_and_cleaners(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.0, "06/2020"), (2, None, None, "x"), (3, "b", 3.0, None)], "PATNO int, k string, v double, d string")
    fe = features.FeatureEngineer(df).one_hot_encode(columns=["k"]).impute("simple_mean").transform_numeric_distribution("v", "log")
    assert fe.summary()["new_features"] == 2 and fe.df.filter("v is null").count() == 0
    assert features.box_cox_lambda(spark.range(1, 200).selectExpr("double(id) as x"), "x") == pytest.approx(0.7, abs=0.1)
    for method in ("knn", "mice"):
        assert features.impute(df.withColumn("w", df.PATNO * 2.0), method, ["v", "w"]).filter("v is null").count() == 0
    with pytest.raises(ValueError):
        features.impute(df, "no")
    assert [r.m for r in df.select(cleaners.event_id_to_months(cleaners.F.lit("V04")).alias("m")).collect()] == [12] * 3
    assert str(df.select(scalar.month_date(df.d).alias("m")).first().m) == "2020-06-01"
    io.write_arff(df, f"{tmp_path}/a")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/a").collect()]
    assert lines[0] == "@RELATION data" and any(x.upper().startswith("@ATTRIBUTE") and "NUMERIC" in x.upper() for x in lines) and "@DATA" in [x.upper() for x in lines]
    assert io.parse_modalities("Biospecimen; nope") == ["biospecimen"]


def test_selection_methods(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 300)
    cols = {"good": y + r.normal(0, 0.3, 300), "twin": y + r.normal(0, 0.4, 300), "noise": r.normal(0, 1, 300), "same": np.ones(300)}
    df = spark.createDataFrame([(int(t), *(float(cols[c][k]) for c in cols)) for k, t in enumerate(y)], "y int, good double, twin double, noise double, same double").cache()
    for method in ("k_best", "fdr", "rfe", "mrmr", "tree_importance", "correlation", "select_from_model", "relief"):
        s = select.FeatureSelector(method, param=0.05 if method == "fdr" else 0.5).fit(df, list(cols), "y")
        assert ("good" in s.selected or "twin" in s.selected) and "same" not in s.selected, method
    with pytest.raises(ValueError):
        select.FeatureSelector("no")
    with pytest.raises(RuntimeError):
        select.FeatureSelector().transform(df)


def test_models(spark):
    r = np.random.default_rng(4)
    rows = [("p" if a + e > 0 else "n", float(a), float(e)) for a, e in zip(r.normal(0, 1, 300), r.normal(0, 0.3, 300), strict=True)]
    c = ml.Classifier()
    c.setup_experiment(spark.createDataFrame(rows, "COHORT string, a double, e double"), "COHORT", folds=2)
    best = c.compare_models(include=["lr", "dt"])[0]
    assert c.leaderboard[0]["Accuracy"] > 0.9 and "prediction_score_p" in c.predict_model(best).columns
    assert c.calibrate_model("lr", "platt")(c.exp.test).filter("calibrated between 0 and 1").count() == c.exp.test.count()
    assert c.create_ensemble(["lr", "dt"], "super_learner")(c.exp.test).filter("prediction = label").count() / c.exp.test.count() > 0.85
    assert c.explain_model(best)[0][1] > 0 and 0 <= c.validate_drift()["auc"] <= 1


def test_benjamini_hochberg_without_one_task(spark):
    r = random.Random(3)
    p = [round(r.random() ** 3, 3) for _ in range(3000)] + [None, None]
    df = spark.createDataFrame(list(enumerate(p)), "feature long, p double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = stats.benjamini_hochberg(df).selectExpr("*", "spark_partition_id() AS part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = stats.adjust_pvalues(p[:3000], "fdr_bh")["p_adjusted"] + [None, None]
    assert len(got) == len(p) and len({x.part for x in got}) > 1
    assert all(x.p_adj == want[x.feature] or math.isclose(x.p_adj, want[x.feature], rel_tol=1e-12) for x in got)


@pytest.mark.parametrize("method", ["adasyn", "smoteenn", "smotetomek"])
def test_balancing_by_neighbours(spark, method):
    r = np.random.default_rng(7)
    rows = [("a", float(x), float(x + y)) for x, y in r.normal(0, 1, (60, 2))] + [("b", float(x), float(x + y)) for x, y in r.normal(1, 1, (15, 2))]
    out = features.balance(spark.createDataFrame(rows, "y string, x double, z double"), "y", method)
    sizes = {x.y: x["count"] for x in out.groupBy("y").count().collect()}
    assert out.columns == ["y", "x", "z"] and sizes["b"] > 15
    assert sizes["a"] == 60 if method == "adasyn" else sizes["a"] < 60
    with pytest.raises(ValueError):
        features.balance(spark.createDataFrame(rows, "y string, x double, z double"), "y", "no")


def test_normality_takes_all_values(spark):
    r = random.Random(8)
    for values in ([float(r.choice((0, 1, 2, 3, 4))) for _ in range(6000)], [r.gauss(3, 2) for _ in range(6000)]):
        got = stats.normality_test(spark.createDataFrame([(x,) for x in values], "v double"), "v")
        w, p = special.shapiro_wilk(sorted(values))
        assert math.isclose(got["statistic"], w, rel_tol=1e-9) and math.isclose(got["p_value"], p, rel_tol=1e-5, abs_tol=1e-12)


def test_exact_quantiles(spark):
    """Against numpy, with ties, nulls and groups of one."""
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(g, None if x % 11 == 0 else float(x % 37)) for g, n in (("a", 200), ("b", 7), ("c", 1)) for x in r.integers(1, 5000, n).tolist()] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"low": 0.1, "mid": 0.5, "high": 0.93}
    got = {x.g: x for x in scalar.exact_quantiles(df, "v", shares, ["g"]).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        if own:
            assert [got[g][k] for k in shares] == pytest.approx(np.quantile(own, list(shares.values())).tolist())
    assert "d" not in got
    assert scalar.column_medians(df.limit(0), ["v"]) == {"v": None}


def test_merge_takes_the_first_value_of_each_column(spark):
    a = spark.createDataFrame([("1", "BL", 2, None, "x"), ("1", "BL", 1, 5.0, None), ("1", None, 1, 7.0, "z"), (None, "BL", 1, 9.0, "q")], "PATNO string, EVENT_ID string, o int, v double, w string")
    b = spark.createDataFrame([("2", "BL", 1, 3)], "PATNO string, EVENT_ID string, o int, v int")
    got = {(r.PATNO, r.EVENT_ID): r for r in reduce.merge_study(Study.of({"a": a, "b": b}), order_by="o").collect()}
    assert set(got) == {("1", "BL"), ("1", None), ("2", "BL")}
    assert (got["1", "BL"].a_v, got["1", "BL"].a_w, got["1", None].a_v, got["2", "BL"].b_v, got["2", "BL"].a_v) == (5.0, "x", 7.0, 3, None)


def test_durbin_watson_and_spearman(spark):
    import numpy as np

    r = np.random.default_rng(5)
    e = r.normal(size=500)
    df = spark.createDataFrame([(k, float(v), float(k % 7), float((k * k) % 5)) for k, v in enumerate(e)], "k int, residual double, x double, y double")
    assert stats.durbin_watson(df, "k") == pytest.approx(float((np.diff(e) ** 2).sum() / (e**2).sum()))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    x, y = (np.array([f(k) for k in range(500)], float) for f in (lambda k: k % 7, lambda k: (k * k) % 5))
    assert stats.correlate_pair(df, "x", "y", "spearman")["r"] == pytest.approx(float(np.corrcoef(rank(x), rank(y))[0, 1]))


def test_venn_abers_cells():
    """Against the min-max formula of the rising fit, on small counts with empty cells and ties."""
    r = random.Random(9)
    for _ in range(20):
        n = np.array([r.choice((0, 0, 1, 2, 5)) for _ in range(12)], float)
        hit = np.array([r.randint(0, int(x)) for x in n], float)

        def fit(w, h, k):
            spans = lambda i: [h[i : j + 1].sum() / w[i : j + 1].sum() for j in range(k, len(w))]
            return max(min(spans(i)) for i in range(k + 1) if w[i : k + 1].sum())

        for k, got in enumerate(ml.venn_abers_cells(n, hit)):
            more, own = n.copy(), hit.copy()
            more[k] += 1
            own[k] += 1
            p0, p1 = fit(more, hit, k), fit(more, own, k)
            assert got == pytest.approx(p1 / (1 - p0 + p1)) and p0 <= p1


def test_blending_and_calibration(spark):
    r = np.random.default_rng(8)
    x, e = r.normal(0, 1, 400), r.normal(0, 0.3, 400)
    two = [("p" if a + b > 0 else "n", float(a), float(b)) for a, b in zip(x, e, strict=True)]
    three = [("low" if a + b < -0.5 else "mid" if a + b < 0.5 else "high", float(a), float(b)) for a, b in zip(x, e, strict=True)]
    c = ml.Classifier()
    c.setup_experiment(spark.createDataFrame(two, "COHORT string, a double, e double"), "COHORT", folds=2)
    n = c.exp.test.count()
    for method in ("blending", "bma"):
        assert c.create_ensemble(["lr", "nb"], method)(c.exp.test).filter("prediction = label").count() / n > 0.85, method
    scored = c.calibrate_model("nb", "venn_abers")(c.exp.test)
    assert scored.filter("calibrated > 0 and calibrated < 1").count() == n
    assert scored.filter("(calibrated > 0.5) = (label = 1)").count() / n > 0.85
    c.setup_experiment(spark.createDataFrame(three, "COHORT string, a double, e double"), "COHORT", folds=2)
    n = c.exp.test.count()
    for method in ("platt", "isotonic", "temperature_scaling", "venn_abers"):
        scored = c.calibrate_model("lr", method)(c.exp.test).selectExpr("label", "calibrated", "aggregate(calibrated, 0D, (a, x) -> a + x) as total")
        assert scored.filter("abs(total - 1) < 1e-9 and array_min(calibrated) >= 0").count() == n, method
        assert scored.filter("array_position(calibrated, array_max(calibrated)) - 1 = label").count() / n > 0.85, method
    with pytest.raises(ValueError):
        c.calibrate_model("lr", "no")
