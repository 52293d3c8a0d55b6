"""Studies loaded and saved in every form, the pipeline on raw files, samples, imputation from training rows, degenerate data."""

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.model import Study, TableKey
from cohortloom.operators import features, ml, report, select, stats
from cohortloom.operators.plot_data import plot_data
from cohortloom.plans import pipeline
from cohortloom.sources import io, study


def raw_folder(spark, path):
    """Two modalities as CSV files; FEATBRADY 2 means uncertain; the score follows the cohort."""
    who = [(str(k), "Parkinson's Disease" if k % 2 else "Healthy Control") for k in range(60)]
    io.write_csv(spark.createDataFrame([(p, "BL", c) for p, c in who], "PATNO string, EVENT_ID string, COHORT string"), f"{path}/_Subject_Characteristics/Status.csv")
    io.write_csv(spark.createDataFrame([(p, "BL", k % 3) for k, (p, _) in enumerate(who)], "PATNO string, EVENT_ID string, FEATBRADY int"), f"{path}/Medical_History/Features_of_Parkinsonism.csv")
    io.write_csv(spark.createDataFrame([(p, "BL", k % 7 + (k % 2) * 10, k % 5) for k, (p, _) in enumerate(who)], "PATNO string, EVENT_ID string, NP3TOT int, other int"), f"{path}/Motor___MDS-UPDRS/updrs.csv", single=True)
    io.write_csv(spark.createDataFrame([("1", 3)], "PATNO string, x int"), f"{path}/Motor___MDS-UPDRS/PROJ_9_extra.csv")


def test_load_and_save(spark, tmp_path):
    path = f"{tmp_path}/raw"
    raw_folder(spark, path)
    cleaned, plain = (study.load(spark, path, exclude_projects=["9"], clean_data=c) for c in (True, False))
    key = TableKey("medical_history", "Features_of_Parkinsonism")
    assert len(cleaned.tables) == 3 and cleaned.tables[key].filter("FEATBRADY = 0.5").count() == 20 == plain.tables[key].filter("FEATBRADY = 2").count()
    wide = study.load(spark, path, ["motor_assessments", "medical_history"], merge_output=True, output_file=f"{tmp_path}/wide.csv")
    assert wide.count() == 60 == io.read_csv(spark, f"{tmp_path}/wide.csv").count()
    assert set(wide.columns) == {"PATNO", "EVENT_ID", "motor_assessments_updrs_NP3TOT", "motor_assessments_updrs_other", "medical_history_Features_of_Parkinsonism_FEATBRADY"}
    whole = study.load(spark, path, output_file=f"{tmp_path}/each")
    assert sorted(x.name for x in (tmp_path / "each").iterdir()) == ["medical_history.csv", "motor_assessments.csv", "motor_assessments_PROJ_9_extra.csv", "subject_characteristics.csv"]
    assert "updrs_NP3TOT" in io.read_csv(spark, f"{tmp_path}/each/motor_assessments.csv").columns
    assert len(study.save(whole, f"{tmp_path}/tables")) == 4 and study.save(whole, f"{tmp_path}/one.csv", "merged") == [f"{tmp_path}/one.csv"]
    with pytest.raises(ValueError):
        study.save(whole, path, "no")
    assert study.save(Study({}), f"{tmp_path}/none") == []


def test_pipeline_on_files(spark, tmp_path):
    path, out = f"{tmp_path}/raw", f"file://{tmp_path}/out"  # a URI, as on any shared store
    raw_folder(spark, path)
    done = pipeline.run_pipeline(path, out, include=["dt"], n_models=1)
    assert done["classification"]["test"]["Accuracy"] > 0.8
    assert {"confusion_matrix", "class_distribution", "feature", "auc", "pr", "prediction_confidence", "shap"} <= set(done["classification"]["plots"])
    for name in done["classification"]["plots"]:
        assert spark.read.parquet(f"{out}/classification/plots/{name}").columns
    page = (tmp_path / "out/classification/classification_report.html").read_text()
    for title in ("Data", "Class distribution", "Best model", "Tuning", "Test split", "Metrics by class", "Confusion", "Feature importance", "Data of plots", "Recommendations"):
        assert f"<h2>{title}</h2>" in page
    assert "removed %" in page
    tuned = report.classification_report([], {}, [], [], [], [], tuned={"model": "dt", "parameters": "maxDepth=3"})
    assert "maxDepth=3" in tuned


def test_class_metrics():
    rows = [{"label": 0.0, "prediction": 0.0, "n": 6}, {"label": 0.0, "prediction": 1.0, "n": 2}, {"label": 1.0, "prediction": 0.0, "n": 3}]
    a, b = report.class_metrics(rows, ["a", "b"])
    assert (a["precision"], a["recall"], a["rows"]) == (6 / 9, 0.75, 8) and (b["precision"], b["recall"], b["F1"], b["rows"]) == (0, 0, 0, 3)


def test_stratified_sample(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") < 300, "a").otherwise("b").alias("c"))
    got = ml.stratified_sample(rows, "c", 101, "id")
    assert {r.c: r["count"] for r in got.groupBy("c").count().collect()} == {None: 10, "a": 27, "b": 64}
    assert sorted(got.collect()) == sorted(ml.stratified_sample(rows.repartition(7), "c", 101, "id").collect()) and got.columns == rows.columns
    assert ml.stratified_sample(rows, "c", 1000, "id").count() == 1000 and ml.stratified_sample(rows.limit(0), "c", 5, "id").count() == 0
    assert ml.stratified_sample(rows.withColumn("id", F.lit(1)), "c", 10, "id").count() == 10  # rows that repeat


def test_shuffling_keeps_values_and_moves_them(spark):
    rows = spark.range(60).select("id", F.col("id").alias("v"))
    got = select.hashed_shuffle(rows, ["v"], 3).collect()
    assert sorted(r.v for r in got) == list(range(60)) and sum(r.v != r.id for r in got) == 60
    assert select.shuffle_buckets(rows) == 1 and select.hashed_shuffle(rows, ["v"], 3, 9).count() == 60


def test_imputation_from_training_rows(spark):
    train = spark.createDataFrame([(1.0, None, 4.0, "x"), (None, None, 2.0, "y"), (3.0, None, 9.0, "z")], "a double, b double, c double, k string")
    test = spark.createDataFrame([(None, 5.0, None, "w")], "a double, b double, c double, k string")
    for kind, c in (("mean", 5.0), ("median", 4.0)):
        imputer = features.TrainImputer(kind)
        own, other = imputer.fit_transform(train, test)
        assert imputer.dropped == ["b"] and own.columns == ["a", "c", "k"] and [r.a for r in own.collect()] == [1, 2, 3]
        assert [tuple(r) for r in other.collect()] == [(2.0, c, "w")]
    assert features.TrainImputer().fit(train.limit(0)).dropped == ["a", "b", "c"]
    assert features.TrainImputer().fit(train, ["a"]).transform(test.drop("a")).columns == ["b", "c", "k"]
    with pytest.raises(ValueError):
        features.TrainImputer("no")


def test_degenerate_statistics(spark):
    same = spark.createDataFrame([(g, 2.0) for g in "aabbcc"], "g string, v double")
    assert math.isnan(stats.kruskal_wallis(same, "v", "g")["statistic"]) and all(math.isnan(r["p_value"]) for r in stats.dunn_posthoc(same, "v", "g"))
    apart = spark.createDataFrame([(g, v) for g, v in zip("aabbcc", (1.0, 1.0, 1.0, 1.0, 5.0, 5.0), strict=True)], "g string, v double")
    rows = {r["group_a"] + r["group_b"]: r for r in stats.tukey_hsd(apart, "v", "g")}
    assert math.isnan(rows["ab"]["p_adj"]) and not rows["ab"]["reject"] and rows["ac"]["p_adj"] == 0.0 and rows["ac"]["reject"]
    with pytest.raises(ValueError):
        stats.tukey_hsd(same.dropDuplicates(["g"]), "v", "g")
    split = spark.createDataFrame([(float(k), float(k > 9)) for k in range(20)], "x double, y double")
    out = stats.logistic_regression(split, "y", ["x"])
    assert out["auc"] == 1.0 and out["coefficients"]["x"]["or_high"] > 1e6
    assert stats._exp(1e4) == math.inf and math.isnan(stats._exp(math.nan)) and stats._exp(-1e4) == 0.0


def test_explaining_models_without_coefficients(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("string").alias("y"), ((F.col("id") % 2) * 4 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    c = ml.Classifier()
    c.setup_experiment(rows, "y", folds=2)
    model = c.create_model("nb")
    assert c.explain_model(model)[0][0] == "a" and c.explain_model(model)[0][1] > 0.2
    tables = plot_data(c, model)
    assert "shap" not in tables and tables["pca_visualization"].columns == ["class", "pc1", "pc2"]
    best = tables["auc"].agg(F.max("tpr"), F.max("fpr")).first()
    assert tuple(best) == (1.0, 1.0) and tables["feature"].count() == 2 and tables["confusion_matrix"].agg(F.sum("n")).first()[0] == c.exp.test.count()
