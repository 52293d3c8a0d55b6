"""load, reduce, engineer, select, classify: each stage re-runnable from the files of the one before."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import coerce_numeric_majority, quoted
from ..model import KEYS, LEAKAGE_FEATURES, TARGET, ReducerConfig, Study
from ..operators import reduce as R
from ..operators import report
from ..operators.features import FeatureEngineer
from ..operators.ml import TUNING, Classifier, confusion, slow_models, stratified_split
from ..operators.plot_data import plot_data
from ..operators.select import FeatureSelector
from ..session import session
from ..sources import io
from ..sources import study as studies

#: Parameters that tuning may change, as the report names them.
TUNED = {p for grid in TUNING.values() for p in grid}
STEPS = ("reduction", "engineering", "selection", "classification")
REDUCED, ENGINEERED, TRAIN, TEST = "final_reduced_consolidated_data.csv", "final_engineered_dataset.csv", "selected_train_data.csv", "selected_test_data.csv"


@report.timed("reduction")
def reduce_stage(study: Study, out: str, config: ReducerConfig | None = None) -> dict:
    before = [r.asDict() for r in R.study_summary(study).collect()]
    drops = R.analyze(study, config)
    slim = R.apply_drops(study, drops)
    wide = R.consolidate_cohort(R.merge_study(slim))
    io.write_csv(wide, f"{out}/{REDUCED}")
    io.write_text(wide.sparkSession, f"{out}/data_reduction_report.html", report.reduction_report(before, [r.asDict() for r in R.study_summary(slim).collect()], drops))
    return {"dropped": sum(map(len, drops.values()))}


@report.timed("engineering")
def engineer_stage(spark: SparkSession, out: str) -> dict:
    df = io.read_csv(spark, f"{out}/{REDUCED}")
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c not in (*KEYS, TARGET)]
    fe = FeatureEngineer(df).one_hot_encode(max_categories=20, auto_threshold=25, min_frequency=0.01)
    fe.scale_numeric_features(columns=numeric)  # dummies stay 0 and 1
    io.write_csv(fe.df, f"{out}/{ENGINEERED}")
    io.write_text(spark, f"{out}/feature_engineering_report.html", report.engineering_report(fe.summary()))
    return fe.summary()


@report.timed("selection")
def select_stage(spark: SparkSession, out: str, leakage: list[str] = (), method: str = "fdr", param: float = 0.05, target: str = TARGET, group: str | None = None) -> dict:
    df = R.drop_leakage(io.read_csv(spark, f"{out}/{ENGINEERED}"), list(leakage)).filter(quoted(target).isNotNull())
    keys, _ = R.key_feature_split(df, target)
    df = R.drop_non_numeric(coerce_numeric_majority(df), [*keys, target])
    columns = [c for c in df.columns if c not in (*keys, target)]
    df = df.fillna(0, subset=columns)
    train, test = stratified_split(df, target, 0.2, 42, group)
    labels = sorted(r[0] for r in df.select(target).distinct().collect())
    code = F.create_map(*[F.lit(x) for k, v in enumerate(labels) for x in (v, float(k))])[quoted(target)]
    selector = FeatureSelector(method, param=param).fit(train.withColumn("_y", code), columns, "_y", test)
    for part, name in ((train, TRAIN), (test, TEST)):
        io.write_csv(part.select(*[quoted(c) for c in selector.selected], quoted(target)), f"{out}/{name}")
    io.write_text(spark, f"{out}/feature_selection_report.html", report.selection_report(len(columns), selector.selected, method))
    return {"candidates": len(columns), "selected": selector.selected}


@report.timed("classification")
def classify_stage(spark: SparkSession, out: str, target: str = TARGET, n_models: int = 5, tune: bool = False, budget_minutes: float | None = 30, include: list[str] | None = None) -> dict:
    paths = io.detect_inputs(spark, out)
    train = io.read_csv(spark, paths.get("train", paths.get("data")))
    test = io.read_csv(spark, paths["test"]) if "test" in paths else None
    c = Classifier()
    exp = c.setup_experiment(train, target, test)
    exclude = slow_models(train.count(), len(exp.features))
    models = c.compare_models(include=include, exclude=exclude, n_select=n_models, budget_minutes=budget_minutes)
    if not models:
        raise RuntimeError("no model could be fitted")
    best, tuned = models[0], {}
    if tune:
        before = c.leaderboard[0]["Accuracy"]
        best = c.tune_model(c.leaderboard[0]["model"])
        tuned = {"model": c.leaderboard[0]["model"], "accuracy before": before, "parameters": ", ".join(f"{p.name}={v}" for p, v in sorted(best.extractParamMap().items(), key=lambda x: x[0].name) if p.name in TUNED)}
    scores = c.evaluate_model(best)
    folder = io.ensure_folder(spark, f"{out}/classification")
    from pyspark.ml import PipelineModel

    io.save_model(PipelineModel([best]), f"{folder}/final_classifier_model", {"labels": exp.labels, "features": exp.features, "target": target})
    counts = [r.asDict() for r in confusion(best.transform(exp.test)).orderBy("label", "prediction").collect()]
    classes = [r.asDict() for r in train.groupBy(target).count().orderBy(target).collect()]
    plots = plot_data(c, best)
    for name, table in plots.items():
        table.write.mode("overwrite").parquet(f"{folder}/plots/{name}")
    # Of the columns that reduction left, the share that selection removed.
    whole = len(spark.read.csv(f"{out}/{REDUCED}", header=True).columns) if io.exists(spark, f"{out}/{REDUCED}") else len(train.columns)
    removed = max(0.0, 100.0 * (1 - len(exp.features) / max(whole, 1)))
    data = {"rows of training": train.count(), "rows of the test split": exp.test.count(), "features": len(exp.features), "columns before selection": whole, "removed %": round(removed, 1), "classes": len(exp.labels)}
    notes = report.recommendations(scores["Accuracy"], removed, len(exp.labels))
    text = report.classification_report(c.leaderboard, scores, c.explain_model(best), classes, counts, notes, data, tuned, exp.labels, sorted(plots))
    io.write_text(spark, f"{folder}/classification_report.html", text)
    return {"leaderboard": c.leaderboard, "test": scores, "plots": sorted(plots)}


def run_pipeline(data: str, out: str, modalities: str | None = None, leakage_path: str | None = None, skip_to: str | None = None, method: str = "fdr", param: float = 0.05, n_models: int = 5, tune: bool = False, budget_minutes: float = 30, study: Study | None = None, include: list[str] | None = None, clean_data: bool = True) -> dict:
    """Tables that are read from ``data`` pass their cleaners unless ``clean_data`` is off; a study that is given stays as it is."""
    spark = session()
    io.ensure_folder(spark, out)
    first = STEPS.index(skip_to) if skip_to else 0
    needs = {1: REDUCED, 2: ENGINEERED, 3: TRAIN}
    if first in needs:
        io.require(spark, f"{out}/{needs[first]}")
    leakage = LEAKAGE_FEATURES if leakage_path == "builtin" else io.read_leakage(spark, leakage_path) if leakage_path else []
    done = {}
    if first <= 0:
        done["reduction"] = reduce_stage(study or studies.load(spark, data, io.parse_modalities(modalities), clean_data=clean_data), out)
    if first <= 1:
        done["engineering"] = engineer_stage(spark, out)
    if first <= 2:
        done["selection"] = select_stage(spark, out, leakage, method, param)
    done["classification"] = classify_stage(spark, out, n_models=n_models, tune=tune, budget_minutes=budget_minutes, include=include)
    io.write_text(spark, f"{out}/pipeline_report.html", report.summary_report([{"stage": k, "seconds": v["seconds"]} for k, v in done.items()]))
    return done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Cohort pipeline")
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--modalities")
    p.add_argument("--leakage", help="a file of feature names, or builtin for the names known to give the diagnosis away")
    p.add_argument("--raw", action="store_true", help="leave the tables uncleaned")
    p.add_argument("--skip-to", choices=STEPS)
    p.add_argument("--method", default="fdr", choices=FeatureSelector.METHODS)
    p.add_argument("--param", type=float, default=0.05)
    p.add_argument("--models", type=int, default=5)
    p.add_argument("--tune", action="store_true")
    p.add_argument("--budget", type=float, default=30)
    a = p.parse_args(argv)
    run_pipeline(a.data, a.output, a.modalities, a.leakage, a.skip_to, a.method, a.param, a.models, a.tune, a.budget, clean_data=not a.raw)


if __name__ == "__main__":
    main()
