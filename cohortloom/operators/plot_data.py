"""The data of a model's plots as tables, one a plot: written beside the report, to be drawn by any tool."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from .ml import Classifier, confusion, pca2, stratified_sample
from .shap import mean_effects
from .stats import _corr_array, roc_table

PLANE_ROWS = 2000
SHAP_ROWS = 100
CONFIDENCE_BINS = 20
STRONG = 0.8


def plot_data(c: Classifier, model, seed: int = 42) -> dict[str, DataFrame]:
    """By name of the plot. The plane shows at most ``PLANE_ROWS`` rows in the classes' shares, effects are means over at most
    ``SHAP_ROWS``; all else covers the whole test split."""
    exp, spark = c.exp, c.exp.train.sparkSession
    name = F.element_at(F.array(*[F.lit(x) for x in exp.labels]), F.col("label").cast("int") + 1)
    scored = model.transform(exp.test)
    out = {
        "confusion_matrix": confusion(scored),
        "class_distribution": exp.train.groupBy(name.alias("class")).agg(F.count("*").alias("n")),
        "feature": spark.createDataFrame(c.explain_model(model, top=len(exp.features)) or [("", 0.0)], "feature string, importance double"),
    }
    if "probability" in scored.columns:
        p = scored.withColumn("_p", vector_to_array("probability"))
        curves = []
        for k in [1] if len(exp.labels) == 2 else range(len(exp.labels)):
            rows = p.select(F.col("_p")[k].alias("s"), (F.col("label") == k).cast("int").alias("y"))
            curves.append(roc_table(rows, "s", "y").select(F.lit(exp.labels[k]).alias("class"), "threshold", "fpr", "tpr", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")))
        table = curves[0]
        for more in curves[1:]:
            table = table.unionByName(more)
        out["auc"], out["pr"] = table.drop("precision"), table.select("class", "threshold", F.col("tpr").alias("recall"), "precision")
        bucket = F.least(F.floor(F.array_max("_p") * CONFIDENCE_BINS), F.lit(CONFIDENCE_BINS - 1)) / CONFIDENCE_BINS
        out["prediction_confidence"] = p.groupBy(bucket.alias("from"), (F.col("prediction") == F.col("label")).alias("right")).agg(F.count("*").alias("n"))
    if len(exp.features) > 1:
        r = _corr_array(exp.train, exp.features)[0]
        pairs = [(a, b, float(r[i, j])) for i, a in enumerate(exp.features) for j, b in enumerate(exp.features) if i < j]
        out["feature_correlation"] = spark.createDataFrame(pairs, "a string, b string, r double")
        out["high_correlation_pairs"] = out["feature_correlation"].filter(F.abs("r") >= STRONG)
        plane = stratified_sample(exp.train.withColumn("class", name), "class", PLANE_ROWS, exp.features, seed)
        out["pca_visualization"] = pca2(plane.select("class", *map(quoted, exp.features)), exp.features).select("class", "pc1", "pc2")
    try:
        rows = stratified_sample(exp.test, "label", SHAP_ROWS, exp.features, seed)
        effects = mean_effects(model, rows)
    except TypeError:  # not a model of trees
        return out
    out["shap"] = spark.createDataFrame([(f, float(v)) for f, v in zip(exp.features, effects, strict=True)], "feature string, effect double")
    return out
