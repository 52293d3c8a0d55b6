"""Loading and saving whole studies: cleaned, merged, in one table or several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import cleaners
from ..model import Study, TableKey
from ..operators.reduce import merge_study
from . import io

FORMS = ("tables", "modalities", "merged")


def load(spark: SparkSession, path: str, modalities: list[str] | None = None, exclude_projects: list[str] | None = None, clean_data: bool = True, merge_output: bool = False, output_file: str | None = None, infer: bool = True) -> Study | DataFrame:
    """The study in folder ``path``: its tables, or with ``merge_output`` one table, a row a subject and visit.

    With ``clean_data`` each table passes its cleaner. ``output_file`` names where the result is written, too: the merged table, or a
    folder of a table a modality.
    """
    study = io.load_study(spark, path, modalities, exclude_projects, infer)
    if clean_data:
        study = cleaners.clean(study)
    if merge_output:
        wide = merge_study(study)
        if output_file:
            io.write_csv(wide, output_file)
        return wide
    if output_file:
        save(study, output_file, "modalities")
    return study


def by_modality(study: Study) -> Study:
    """A table a modality: its tables merged by subject and visit. Tables without these keys stay as they are, under their own names."""
    out: dict[TableKey, DataFrame] = {}
    for modality in dict.fromkeys(k.modality for k in study.tables):
        own = Study({TableKey(k.table or k.modality): df for k, df in study.tables.items() if k.modality == modality})
        keyed = Study({k: df for k, df in own.tables.items() if {"PATNO", "EVENT_ID"} <= set(df.columns)})
        if keyed.tables:
            out[TableKey(modality)] = merge_study(keyed)
        out |= {TableKey(modality, k.modality): df for k, df in own.tables.items() if k not in keyed.tables}
    return Study(out)


def save(study: Study, path: str, form: str = "tables") -> list[str]:
    """CSV folders below ``path``: one a table, one a modality, or one merged (``path`` itself). Returns what was written."""
    if form not in FORMS:
        raise ValueError(f"unknown form {form}")
    if form == "merged":
        io.write_csv(merge_study(study), path)
        return [path]
    tables = study.tables if form == "tables" else by_modality(study).tables
    written = []
    for key, df in tables.items():
        written.append(f"{path}/{key.prefix}.csv")
        io.write_csv(df, written[-1])
    return written
