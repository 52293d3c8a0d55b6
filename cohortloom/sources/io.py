"""Readers and writers at the edges of the engine; Parquet is used between stages."""

from __future__ import annotations

import json
import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import is_numeric, nulls_for_nan, quoted
from ..model import MODALITIES, Study, TableKey

log = logging.getLogger(__name__)
FOLDERS = {"_Subject_Characteristics": "subject_characteristics", "Biospecimen": "biospecimen", "Motor___MDS-UPDRS": "motor_assessments", "Non-motor_Assessments": "non_motor_assessments", "Medical_History": "medical_history"}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def require(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    return nulls_for_nan(spark.read.csv(require(spark, path), header=True, inferSchema=infer))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A folder of CSV files, or with ``single`` of one file, which one task writes."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def parse_modalities(text: str | None) -> list[str]:
    """Names split at ; , or white space; unknown ones warn; none left means all."""
    names = [x.strip().lower() for x in re.split(r"[;,\s]+", text or "") if x.strip()]
    for x in names:
        if x not in MODALITIES:
            log.warning("unknown modality %s", x)
    return [x for x in names if x in MODALITIES] or list(MODALITIES)


def modalities_of(text: Column) -> Column:
    """parse_modalities for a column, without warnings."""
    names = F.filter(F.split(F.lower(text), r"[;,\s]+"), lambda x: x.isin(*MODALITIES))
    return F.when(F.size(names) > 0, names).otherwise(F.array(*map(F.lit, MODALITIES)))


def load_study(spark: SparkSession, path: str, modalities: list[str] | None = None, exclude_projects: list[str] | None = None, infer: bool = True) -> Study:
    """A folder of folders of CSV files. Files of excluded projects are not opened; rows of excluded PROJ_IDs are filtered."""
    fs, root = _fs(spark, require(spark, path))
    tables: dict[TableKey, DataFrame] = {}
    skip = {str(x).lower() for x in exclude_projects or []}
    for folder in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
        modality = FOLDERS.get(folder.getPath().getName(), folder.getPath().getName().lower())
        if not folder.isDirectory() or modality not in (modalities or MODALITIES):
            continue
        for file in sorted(fs.listStatus(folder.getPath()), key=lambda s: s.getPath().getName()):
            name = file.getPath().getName()
            table = name.removesuffix(".csv")
            if not name.endswith(".csv") or any(re.search(rf"(?<![0-9a-z]){re.escape(p)}(?![0-9a-z])", table.lower()) for p in skip):
                continue
            df = read_csv(spark, file.getPath().toString(), infer)
            if "PROJ_ID" in df.columns and skip:
                df = df.filter(F.col("PROJ_ID").isNull() | ~F.lower(F.col("PROJ_ID").cast("string")).isin(*skip))
            tables[TableKey(modality, table)] = df
    return Study(tables)


def read_leakage(spark: SparkSession, path: str) -> list[str]:
    """Distinct non-blank lines, in order: a configuration file."""
    lines = (r.value.strip() for r in spark.read.text(require(spark, path)).collect())
    return list(dict.fromkeys(x for x in lines if x))


def detect_inputs(spark: SparkSession, folder: str) -> dict[str, str]:
    """Selected train and test files, else the engineered one."""
    has = lambda name: exists(spark, f"{folder}/{name}")
    for names in (("selected_train_data.csv", "selected_test_data.csv"), ("final_engineered_dataset.csv",)):
        if all(map(has, names)):
            return dict(zip(("train", "test") if len(names) == 2 else ("data",), (f"{folder}/{n}" for n in names), strict=True))
    raise FileNotFoundError(f"no selected or engineered data in {folder}")


def write_arff(df: DataFrame, path: str, relation: str = "data") -> None:
    """Header lines and rows as text, one file: numbers, dates and quoted strings, ? for NULL."""
    kinds = {c: "NUMERIC" if is_numeric(t) or t == "boolean" else "DATE 'yyyy-MM-dd HH:mm:ss'" if t.startswith(("date", "timestamp")) else "STRING" for c, t in df.dtypes}
    cells = []
    for c, kind in kinds.items():
        x = quoted(c)
        x = F.date_format(x, "yyyy-MM-dd HH:mm:ss") if kind.startswith("DATE") else x.cast("int").cast("string") if dict(df.dtypes)[c] == "boolean" else x.cast("string")
        if kind != "NUMERIC":
            x = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
        cells.append(F.coalesce(x, F.lit("?")))
    head = [f"@RELATION {relation}", "", *(f"@ATTRIBUTE '{c}' {k}" for c, k in kinds.items()), "", "@DATA"]
    spark = df.sparkSession
    header = spark.createDataFrame([("\n".join(head),)], "value string")
    header.unionAll(df.select(F.concat_ws(",", *cells).alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("reading .xlsx needs openpyxl") from e
    import pandas as pd

    return nulls_for_nan(spark.createDataFrame(pd.read_excel(path)))


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Subject, Structure, Volume_mm3 rows as a row a subject and a column a structure."""
    rows = spark.read.csv(require(spark, path), header=True, schema="Subject string, Structure string, Volume_mm3 double")
    return pivot_volumes(rows)


def pivot_volumes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Subject").pivot("Structure").agg(F.first("Volume_mm3"))


def save_model(model, path: str, sidecar: dict) -> None:
    model.write().overwrite().save(path)
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(sidecar),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".json")


def load_model(path: str):
    from pyspark.ml import PipelineModel

    spark = SparkSession.active()
    return PipelineModel.load(path), json.loads(spark.read.text(path + ".json").first().value)


def ensure_folder(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """One small file, such as a report, wherever Spark can write."""
    fs, where = _fs(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return path
