"""Cleaners of raw study tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import month_date, quoted

# Months since baseline by visit code.
VISIT_MONTHS = {"SC": 0, "BL": 0, "V01": 3, "V02": 6, "V03": 9, "V04": 12, "V05": 18, "V06": 24, "V07": 30, "V08": 36, "V09": 42, "V10": 48, "V11": 54, "V12": 60, "V13": 72, "V14": 84, "V15": 96, "V16": 108, "V17": 120}
BP_LABELS = {0: "normal", 1: "elevated", 2: "stage 1", 3: "stage 2", 4: "crisis"}


def event_id_to_months(c: Column) -> Column:
    pairs = [F.lit(x) for kv in VISIT_MONTHS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def dt_to_date(c: Column) -> Column:
    return month_date(c)


def blood_pressure_code(systolic: Column, diastolic: Column) -> Column:
    """0 to 4 by the ACC/AHA thresholds of 2017 (a choice of this library; the study's own are not published)."""
    code = F.when((systolic > 180) | (diastolic > 120), 4).when((systolic >= 140) | (diastolic >= 90), 3).when((systolic >= 130) | (diastolic >= 80), 2).when(systolic >= 120, 1)
    return F.when(systolic.isNotNull() & diastolic.isNotNull(), code.otherwise(0))


def clean_vital_signs(df: DataFrame) -> DataFrame:
    out = {}
    for position, s, d in (("Sup", "SYSSUP", "DIASUP"), ("Stnd", "SYSSTND", "DIASTND")):
        if s in df.columns and d in df.columns:
            code = blood_pressure_code(F.col(s), F.col(d))
            out[f"{position} BP code"] = code
            label = F.lit(None).cast("string")
            for k, name in BP_LABELS.items():
                label = F.when(code == k, name).otherwise(label)
            out[f"{position} BP label"] = label
    return df.withColumns(out) if out else df


def uncertain(df: DataFrame, prefix: str, value: float = 0.5) -> DataFrame:
    """2 means uncertain in columns that begin with ``prefix``."""
    names = [c for c in df.columns if c.upper().startswith(prefix)]
    return df.withColumns({c: F.when(quoted(c) == 2, F.lit(value)).otherwise(quoted(c).cast("double")) for c in names}) if names else df


def clean_features_of_parkinsonism(df: DataFrame, uncertain_value: float = 0.5) -> DataFrame:
    return uncertain(df, "FEAT", uncertain_value)


def clean_gen_physical_exam(df: DataFrame, uncertain_value: float = 0.5) -> DataFrame:
    return uncertain(df, "ABNORM", uncertain_value)


def clean_concomitant_meds(df: DataFrame, indications: DataFrame | None = None) -> DataFrame:
    """Dates from MM/YYYY; free-text indications get codes from ``indications`` (text, code), and codes get texts."""
    dates = {c: month_date(F.col(c)) for c in ("STARTDT", "STOPDT") if c in df.columns}
    out = df.withColumns(dates) if dates else df
    if indications is not None and {"CMINDC", "CMINDC_TEXT"} <= set(df.columns):
        by_text = indications.select(F.lower("text").alias("_t"), F.col("code").alias("_code")).dropDuplicates(["_t"])
        by_code = indications.groupBy(F.col("code").alias("_c")).agg(F.min("text").alias("_text"))
        out = out.join(by_text, F.lower(F.trim("CMINDC_TEXT")) == F.col("_t"), "left").withColumn("CMINDC", F.coalesce("CMINDC", "_code"))
        out = out.join(by_code, F.col("CMINDC") == F.col("_c"), "left").withColumn("CMINDC_TEXT", F.coalesce("CMINDC_TEXT", "_text")).drop("_t", "_code", "_c", "_text")
    return out


def unable_to_rate(df: DataFrame, prefix: str = "NP3") -> DataFrame:
    """101 in motor items means that the item could not be rated."""
    names = [c for c in df.columns if c.upper().startswith(prefix)]
    return df.withColumns({c: F.nullif(quoted(c), F.lit(101)) for c in names}) if names else df


CLEANERS = {"vital_signs": clean_vital_signs, "features_of_parkinsonism": clean_features_of_parkinsonism, "gen_physical_exam": clean_gen_physical_exam, "concomitant_meds": clean_concomitant_meds}


def clean(study, cleaners=None):
    """Each table through its cleaner, by lower-case table name; others stay."""
    cleaners = CLEANERS if cleaners is None else cleaners
    return study.map(lambda k, df: cleaners.get((k.table or k.modality).lower(), lambda x: x)(df))
