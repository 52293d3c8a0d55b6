"""The jobs as registered queries: each runs its job twice into a new folder and returns the output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import scratch_path

from . import text_features, visit_changes


def _rounded(df: DataFrame, *dropped: str) -> DataFrame:
    """Doubles by six digits, without negative zeros."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in dropped])


def job1_text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job1")
    for _ in range(2):
        out = text_features.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{folder}/features")
    return _rounded(out)


def job2_visit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "job2")
    for _ in range(2):  # a file stream takes a folder or a pattern, not a single file
        out = visit_changes.run(spark, f"{sf_dir}/events.parque[t]", f"{folder}/visits", f"{folder}/checkpoint")
    return _rounded(out, "bucket")


_Z = ", ".join(f"round(CASE WHEN sd_{f} > 0 THEN (coalesce({f}, q50_{f}) - mean_{f}) / sd_{f} WHEN sd_{f} = 0 THEN 0 END, 6) + 0.0 AS z_{f}" for f in text_features.FEATURES)
_BEYOND = " + ".join(f"CASE WHEN {f} < q25_{f} - 1.5 * (q75_{f} - q25_{f}) OR {f} > q75_{f} + 1.5 * (q75_{f} - q25_{f}) THEN 1 ELSE 0 END" for f in text_features.FEATURES)
_QUARTILES = ", ".join(f"quantile_cont({f}, {share}) AS q{round(100 * share)}_{f}" for f in text_features.FEATURES for share in (0.25, 0.5, 0.75))
_SCALES = ", ".join(f"avg(coalesce({f}, q50_{f})) AS mean_{f}, stddev_pop(coalesce({f}, q50_{f})) AS sd_{f}" for f in text_features.FEATURES)
_KIND = r"length(regexp_replace(text, '[^{}]+', '', 'g')) / CAST(nullif(length(text), 0) AS DOUBLE)"

JOB1_SQL = rf"""
WITH d AS (SELECT doc_id, text, source, coalesce(nullif(trim(lang), ''), 'und') AS lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, source, lang, CAST(length(text) AS DOUBLE) AS n_chars, CAST(len(ws) AS DOUBLE) AS n_words, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) / CAST(nullif(len(ws), 0) AS DOUBLE) AS mean_word, len(list_distinct(ws)) / CAST(nullif(len(ws), 0) AS DOUBLE) AS distinct_share,
  {_KIND.format("0-9")} AS digit_share, {_KIND.format("A-Z")} AS upper_share, {_KIND.format(r"!-/:-@\[-`{-~")} AS punct_share FROM d),
q AS (SELECT lang, {_QUARTILES} FROM m GROUP BY lang),
s AS (SELECT lang, {_SCALES} FROM m JOIN q USING (lang) GROUP BY lang),
l AS (SELECT doc_id, max(quality) AS cohort FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, source, CAST(cohort AS INTEGER) AS cohort, CASE WHEN CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split, {_BEYOND} AS n_beyond, {_Z}, lang
FROM m JOIN q USING (lang) JOIN s USING (lang) LEFT JOIN l USING (doc_id)
"""

JOB2_SQL = """
WITH v AS (SELECT user_id AS subject, CAST(ts AS DATE) AS visit, coalesce(event_type, 'unknown') AS measure, count(*) AS n_events, count(value) AS n_values, avg(value) AS mean, min(value) AS low, max(value) AS high
  FROM (SELECT * REPLACE (CASE WHEN NOT isnan(value) THEN value END AS value) FROM events) WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER w AS visit_no, first_value(mean IGNORE NULLS) OVER (PARTITION BY subject, measure ORDER BY visit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS baseline FROM v WINDOW w AS (PARTITION BY subject, measure ORDER BY visit))
SELECT subject, visit, measure, CAST(visit_no AS INTEGER) AS visit_no, n_events, n_values, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, round(baseline, 6) AS baseline,
  round(mean - baseline, 6) + 0.0 AS change, round(100 * (mean - baseline) / nullif(baseline, 0), 6) + 0.0 AS pct_change FROM b
"""


def queries() -> dict:
    return {"job1_text_features": job1_text_features, "job2_visit_changes": job2_visit_changes}


def oracle_sql() -> dict[str, str]:
    return {"job1_text_features": JOB1_SQL, "job2_visit_changes": JOB2_SQL}
