"""Profiling, dropping, deduplicating and merging study tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_quantiles, is_numeric, numeric_columns, quoted, string_columns
from ..model import COHORT_SYNONYMS, COHORTS, KEYS, TARGET, ReducerConfig, Study, TableKey

_BATCH = 200


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of string-cast cells: wide tables are profiled in long form."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.column", "x.value")


def _batches(columns: list[str]):
    return (columns[k : k + _BATCH] for k in range(0, len(columns), _BATCH))


def profile_nulls(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_non_null, n_null, null_pct, n_distinct, top_share)"""
    parts = []
    for names in _batches(df.columns):
        counts = _long(df, names).groupBy("column", "value").count()
        parts.append(counts.groupBy("column").agg(F.sum("count").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))), F.lit(0)).alias("n_non_null"), F.count("value").alias("n_distinct"), F.max(F.when(F.col("value").isNotNull(), F.col("count"))).alias("_top")))
    out = functools.reduce(DataFrame.unionByName, parts)
    n = F.col("n_rows")
    return out.select("column", "n_rows", "n_non_null", (n - F.col("n_non_null")).alias("n_null"), (100.0 * (n - F.col("n_non_null")) / n).alias("null_pct"), "n_distinct", (F.col("_top") / F.expr("nullif(n_non_null, 0)")).alias("top_share"))


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max); quartiles are exact."""
    parts = []
    for names in _batches(columns or numeric_columns(df)):
        cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v")) for c in names])
        v = df.select(F.explode(cells).alias("x")).select("x.*")
        g = v.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        parts.append(g.join(exact_quantiles(v, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"]), "column", "left"))
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, value, n, rank): the k commonest values, NULL among them, ties by value."""
    counts = _long(df, columns or string_columns(df)).groupBy("column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _deviations(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").groupBy("column").agg(F.stddev_samp("v").alias("std"))


def drop_suggestions(df: DataFrame, config: ReducerConfig | None = None) -> DataFrame:
    """(column, reason) by the first rule that holds: missing, single value, low variance, high cardinality, metadata."""
    config = config or ReducerConfig()
    names = [c for c in df.columns if c not in config.keys]
    numeric = numeric_columns(df)
    base = profile_nulls(df.select(*[quoted(c) for c in names]))
    own = [c for c in numeric if c in names]
    spread = _deviations(df, own) if own else df.sparkSession.createDataFrame([], "column string, std double")
    lengths = [c for c in string_columns(df) if c in names]
    long_ones = _long(df, lengths).groupBy("column").agg(F.avg(F.length("value")).alias("len")) if lengths else df.sparkSession.createDataFrame([], "column string, len double")
    p = base.join(spread, "column", "left").join(long_ones, "column", "left")
    reason = F.when(F.col("null_pct") / 100 > config.missing_threshold, "missing")
    reason = reason.when((F.col("n_distinct") == 1) & (F.col("top_share") >= config.single_value_threshold), "single_value")
    if config.check_variance:
        reason = reason.when(F.col("std") < config.low_variance_std, "low_variance")
    if config.check_cardinality:
        reason = reason.when((F.col("n_distinct") / F.col("n_rows") > config.high_cardinality_ratio) & (F.col("column").isin(*own) | (F.col("len") > 10)), "high_cardinality")
    reason = reason.when(F.col("column").isin(*config.metadata_columns), "metadata")
    return p.select("column", reason.alias("reason")).filter("reason is not null")


def analyze(study: Study, config: ReducerConfig | None = None) -> dict[str, dict[str, str]]:
    """{table: {column: reason}}, sorted."""
    out = {}
    for key, df in study.tables.items():
        found = drop_suggestions(df, config).collect() if df.columns else []
        out[key.report_key] = dict(sorted((r.column, r.reason) for r in found))
    return out


def report_text(report: dict[str, dict[str, str]], shown: int = 5) -> str:
    lines = []
    for table, reasons in report.items():
        names = list(reasons)
        lines.append(f"{table}: {len(names)} columns to drop" + (": " + ", ".join(names[:shown]) + (" ..." if len(names) > shown else "") if names else ""))
    return "\n".join(lines)


def apply_drops(study: Study, drops: dict[str, dict[str, str] | list[str]]) -> Study:
    """Missing names and tables are ignored; the study given stays as it is."""
    return study.map(lambda k, df: df.drop(*drops.get(k.report_key, ())))


def study_summary(study: Study) -> DataFrame:
    """(table, n_rows, n_columns, n_numeric, n_string, null_pct)"""
    rows = []
    for key, df in study.tables.items():
        nulls = F.lit(0)
        for c in df.columns:
            nulls = nulls + F.count_if(quoted(c).isNull())
        cells = F.count("*") * len(df.columns)
        rows.append(df.agg(F.lit(key.report_key).alias("table"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.lit(len(numeric_columns(df))).alias("n_numeric"), F.lit(len(string_columns(df))).alias("n_string"), F.coalesce(100.0 * nulls / F.when(cells > 0, cells), F.lit(0.0)).alias("null_pct")))
    return functools.reduce(DataFrame.unionByName, rows)


def size_mb(df: DataFrame) -> float:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString()) / 1e6


def dedup_first_non_null(df: DataFrame, keys=KEYS, order_by: str | None = None) -> DataFrame:
    """A row a key, each column its first non-null value; first by ``order_by``, which then leaves, or by file order."""
    names = [c for c in df.columns if c not in keys and c != order_by]
    if not names:
        return df.select(*keys).dropDuplicates(list(keys))
    ordered = df if order_by else df.withColumn("_ord", F.monotonically_increasing_id())
    by = order_by or "_ord"
    picks = [F.min_by(quoted(c), F.when(quoted(c).isNotNull(), quoted(by))).alias(c) for c in names]
    return ordered.groupBy(*keys).agg(*picks)


def prefixed(df: DataFrame, prefix: str, keys=KEYS) -> DataFrame:
    return df.select(*keys, *[quoted(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keys])


def key_spine(tables: list[DataFrame], keys=KEYS) -> DataFrame:
    """The distinct keys of all tables; rows without a subject are dropped, without a visit kept."""
    parts = [df.select(*keys) for df in tables if set(keys) <= set(df.columns)]
    return functools.reduce(DataFrame.union, parts).filter(F.col(keys[0]).isNotNull()).distinct()


def merge_study(study: Study, keys=KEYS, order_by: str | None = None) -> DataFrame:
    """One wide table, a row a key: each table's columns prefixed, each its first non-null value of the key. Tables lacking a
    key stay out, rows without a subject are dropped, without a visit kept.

    The tables are stacked and aggregated by key at once: one shuffle, however many tables there are.
    """
    stacked, picks = [], []
    for key, df in study.tables.items():
        if not set(keys) <= set(df.columns):
            continue
        names = [c for c in df.columns if c not in keys and c != order_by]
        at = quoted(order_by) if order_by else F.monotonically_increasing_id()
        wide = {c: f"{key.prefix}_{c}" for c in names}
        # A table's columns travel as one, null in the rows of the others.
        cell = F.struct(at.alias("at"), *[quoted(c).alias(wide[c]) for c in names])
        tag = f"_t{len(stacked)}"
        stacked.append(df.select(quoted(keys[0]).cast("string").alias(keys[0]), *[quoted(k) for k in keys[1:]], cell.alias(tag)))
        picks += [F.min_by(F.col(f"{tag}.`{wide[c]}`"), F.when(F.col(f"{tag}.`{wide[c]}`").isNotNull(), F.col(f"{tag}.at"))).alias(wide[c]) for c in names]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked).filter(quoted(keys[0]).isNotNull())
    return rows.groupBy(*keys).agg(*picks) if picks else rows.select(*keys).distinct()


def consolidate_cohort(df: DataFrame, sources: list[str] | None = None, target: str = TARGET) -> DataFrame:
    """Sources (by default columns named like the target) coalesced, blanks as NULL, synonyms mapped, invalid labels filtered."""
    sources = sources or [c for c in df.columns if target in c.upper()]
    raw = F.coalesce(*[F.when(F.trim(quoted(c).cast("string")) != "", quoted(c).cast("string")) for c in sources])
    label = raw
    for short, name in COHORT_SYNONYMS.items():
        label = F.when(F.upper(F.trim(raw)) == short, name).otherwise(label)
    kept = [c for c in df.columns if c not in sources]
    return df.select(*[quoted(c) for c in kept], label.alias(target)).filter(F.col(target).isin(*COHORTS))


def drop_leakage(df: DataFrame, leakage: list[str], by_source: bool = True) -> DataFrame:
    """Named columns go; with ``by_source`` also columns derived from them (prefix, one-hot suffix)."""
    gone = set(leakage)
    if by_source:
        gone |= {c for c in df.columns for x in leakage if c.endswith("_" + x) or c.startswith(x + "_") or f"_{x}_" in c}
    return df.drop(*gone)


def remap_numeric_labels(df: DataFrame, target: str, labels: dict) -> DataFrame:
    """Explicit map of codes to labels; codes outside it stop the run."""
    other = df.filter(~quoted(target).isin(*labels)).select(target).distinct().limit(20).collect()
    if other:
        raise ValueError(f"codes without a label: {sorted(r[0] for r in other)}")
    return df.withColumn(target, F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col(target)])


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns if c in df.columns])


def key_feature_split(df: DataFrame, target: str = TARGET, keys=KEYS) -> tuple[list[str], list[str]]:
    own = [k for k in keys if k in df.columns]
    return own, [c for c in df.columns if c not in own and c != target]


def drop_non_numeric(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c, t in df.dtypes if c in keep or is_numeric(t)])


def stack_splits(train: DataFrame, test: DataFrame, tag: str = "_original_split") -> DataFrame:
    return train.withColumn(tag, F.lit("train")).unionByName(test.withColumn(tag, F.lit("test")), allowMissingColumns=True)


def table_key(text: str) -> TableKey:
    return TableKey(*text.split(".", 1))
