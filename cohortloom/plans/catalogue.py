"""Registered queries of the cohort engine on the test tables, each with its SQL where SQL can express it.

Stand-ins: (user_id, date of ts) of events is the patient-visit key, event_type the modality, customer's market segment
the cohort, orders and lineitem repeated assessments, part a code table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaners
from ..functions import scalar as X
from ..model import Study
from ..operators import clinical, features, ml, reduce, select, stats

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _visits(spark, sf) -> DataFrame:
    """Event rows with patient-visit keys; every seventh value is missing."""
    e = _t(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("PATNO"), F.to_date("ts").cast("string").alias("EVENT_ID"), "event_type", F.col("event_id").alias("ordinal"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


_V = "SELECT CAST(user_id AS VARCHAR) AS patno, CAST(CAST(ts AS DATE) AS VARCHAR) AS visit, event_type, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"


def _study(spark, sf) -> Study:
    v = _visits(spark, sf)
    own = sorted(r[0] for r in v.select("event_type").distinct().collect())
    return Study.of({t: v.filter(F.col("event_type") == t).drop("event_type") for t in own})


# Joins, keys, cohorts


@query(f"SELECT DISTINCT patno AS \"PATNO\", visit AS \"EVENT_ID\" FROM ({_V})")
def visit_spine(spark, sf):
    return reduce.key_spine(list(_study(spark, sf).tables.values()))


@query(f"SELECT patno AS \"PATNO\", visit AS \"EVENT_ID\", arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM ({_V}) GROUP BY 1, 2")
def dedup_first_nonnull(spark, sf):
    return reduce.dedup_first_non_null(_visits(spark, sf).drop("event_type"), order_by="ordinal")


@query(f"""WITH v AS ({_V}), w AS (SELECT patno, visit, event_type, arg_min(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM v GROUP BY ALL)
SELECT patno AS "PATNO", visit AS "EVENT_ID", count(*) AS n_tables, count(value) AS n_values, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def visit_merge_wide(spark, sf):
    study = _study(spark, sf)
    marked = study.map(lambda k, df: df.withColumn("seen", F.lit(1)))
    wide = reduce.merge_study(marked, order_by="ordinal")
    values = [c for c in wide.columns if c.endswith("_value")]
    seen = [c for c in wide.columns if c.endswith("_seen")]
    present = lambda cs: sum((F.col(c).isNotNull().cast("bigint") for c in cs), F.lit(0).cast("bigint"))
    total = F.when(present(values) > 0, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in values), F.lit(0.0)))
    return wide.select("PATNO", "EVENT_ID", present(seen).alias("n_tables"), present(values).alias("n_values"), F.round(total, 4).alias("total"))


_LABELS = "CASE c_mktsegment WHEN 'BUILDING' THEN ' PD' WHEN 'MACHINERY' THEN 'control ' WHEN 'HOUSEHOLD' THEN 'Prodromal' WHEN 'AUTOMOBILE' THEN ' ' ELSE 'n/a' END"


@query("""SELECT "COHORT", count(*) AS n FROM (SELECT CASE WHEN upper(trim(raw)) = 'PD' THEN 'Parkinson''s Disease' WHEN upper(trim(raw)) = 'CONTROL' THEN 'Healthy Control' ELSE raw END AS "COHORT"
FROM (SELECT coalesce(CASE WHEN trim(a) <> '' THEN a END, b) AS raw FROM (SELECT """ + _LABELS + """ AS a, CASE WHEN c_custkey % 3 = 0 THEN 'SWEDD' END AS b FROM customer)))
WHERE "COHORT" IN ('Parkinson''s Disease', 'Prodromal', 'Healthy Control', 'SWEDD') GROUP BY 1""")
def cohort_consolidate(spark, sf):
    c = _t(spark, sf, "customer").select(F.expr(_LABELS).alias("x_COHORT"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'SWEDD' END").alias("y_COHORT"), "c_custkey")
    return reduce.consolidate_cohort(c).groupBy("COHORT").agg(F.count("*").alias("n"))


# Profiling


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_non_null, count(*) - count({c}) AS n_null, 100.0 * (count(*) - count({c})) / count(*) AS null_pct, count(DISTINCT {c}) AS n_distinct FROM (SELECT event_type, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)" for c in ("event_type", "user_id", "value")))
def profile_nulls(spark, sf):
    e = _t(spark, sf, "events").select("event_type", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return reduce.profile_nulls(e).drop("top_share")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem" for c in _NUM))
def profile_numeric(spark, sf):
    p = reduce.profile_numeric(_t(spark, sf, "lineitem"), list(_NUM))
    return p.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query("SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY p_brand QUALIFY rank <= 5")
def profile_top5(spark, sf):
    return reduce.top_values(_t(spark, sf, "part"), ["p_brand"])


@query("SELECT * FROM (VALUES ('empty', 'missing'), ('constant', 'single_value'), ('tiny', 'low_variance'), ('REC_ID', 'metadata')) t(\"column\", reason)")
def drop_suggestions(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").alias("PATNO"), F.lit("BL").alias("EVENT_ID"), "value", F.when(F.col("event_id") % 100 == 0, F.col("value")).alias("empty"), F.lit("x").alias("constant"), (F.col("event_id") % 2 / 1000).alias("tiny"), F.col("event_id").alias("REC_ID"))
    return reduce.drop_suggestions(e)


_SUMMARY = ("region", "nation", "customer", "supplier", "part", "orders")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in _SUMMARY))
def study_summary(spark, sf):
    return reduce.study_summary(Study.of({t: _t(spark, sf, t) for t in _SUMMARY})).select("table", "n_rows")


# Scalars and features

_PIPE = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '' || (o_orderkey % 17) ELSE (o_orderkey % 17) || '|' || (o_orderkey % 3) || CASE WHEN o_orderkey % 5 = 4 THEN '|x' ELSE '' END END AS p FROM orders"


def _pipes(spark, sf):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 1, (k % 17).cast("string")).when(k % 5 != 0, F.concat((k % 17).cast("string"), F.lit("|"), (k % 3).cast("string"), F.when(k % 5 == 4, "|x").otherwise("")))
    return _t(spark, sf, "orders").select("o_orderkey", text.alias("p"))


@query(f"""SELECT o_orderkey, CASE WHEN contains(p, '|') THEN list_avg(list_transform(string_split(p, '|'), lambda x: CASE WHEN contains(p, 'x') THEN NULL ELSE try_cast(x AS DOUBLE) END)) ELSE try_cast(p AS DOUBLE) END AS mean,
string_split(p, '|')[1] AS first, CASE WHEN p IS NULL THEN 0 ELSE len(string_split(p, '|')) END AS n FROM ({_PIPE})""")
def pipe_values(spark, sf):
    p = F.col("p")
    return _pipes(spark, sf).select("o_orderkey", X.pipe_average(p).alias("mean"), X.pipe_first(p).alias("first"), X.pipe_count(p).cast("bigint").alias("n"))


@query(f"SELECT o_orderkey, {', '.join(f'CASE WHEN list_contains(string_split(p, chr(124)), {chr(39)}{v}{chr(39)}) THEN 1 ELSE 0 END AS p_{v}' for v in sorted([*map(str, range(17)), 'x']))} FROM ({_PIPE})")
def pipe_multihot(spark, sf):
    return features.pipe_separated(_pipes(spark, sf), "p", "multi_hot")


_BRAND = "SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'rare' || (p_partkey % 100) WHEN p_partkey % 11 = 0 THEN NULL ELSE 'size' || (p_size % 4) END AS kind FROM part"


@query(f"""SELECT p_partkey, {', '.join(f"CASE WHEN kind = 'size{k}' THEN 1 ELSE 0 END AS kind_size{k}" for k in range(4))}, CASE WHEN kind LIKE 'rare%' THEN 1 ELSE 0 END AS "kind__OTHER_" FROM ({_BRAND})""")
def onehot_rare_other(spark, sf):
    k = F.col("p_partkey")
    part = _t(spark, sf, "part").select("p_partkey", F.when(k % 50 == 0, F.concat(F.lit("rare"), k % 100)).when(k % 11 != 0, F.concat(F.lit("size"), F.col("p_size") % 4)).alias("kind"))
    return features.one_hot(part, ["kind"], min_frequency=0.03)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity, round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax FROM lineitem")
def scale_standard(spark, sf):
    out = features.scale(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 6).alias("l_tax"))


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def scale_minmax(spark, sf):
    out = features.scale(_t(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], "minmax")
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("""SELECT event_id, round(v * v, 4) AS "value^2", round(v * u, 4) AS "value user_id", round(u * u, 4) AS "user_id^2" FROM (SELECT event_id, CAST(user_id AS DOUBLE) AS u, coalesce(x, median(x) OVER ()) AS v FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events))""")
def polynomial2(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    out = features.polynomial(e, ["value", "user_id"])
    return out.select("event_id", *[F.round(f"`{c}`", 4).alias(c) for c in ("value^2", "value user_id", "user_id^2")])


@query("SELECT event_id, CASE WHEN value > 50 THEN round(ln(value - 50), 6) END AS log, CASE WHEN value >= 50 THEN round(sqrt(value - 50), 6) END AS sqrt FROM events")
def log_sqrt(spark, sf):
    v = F.col("value")
    return _t(spark, sf, "events").select("event_id", F.round(X.log_offset(v, -50), 6).alias("log"), F.round(X.sqrt_offset(v, -50), 6).alias("sqrt"))


@query(f"SELECT event_id, round(coalesce(value, avg(value) OVER ()), 6) AS mean, round(coalesce(value, median(value) OVER ()), 6) AS median FROM ({_V})")
def impute_simple(spark, sf):
    v = _visits(spark, sf).select(F.col("ordinal").alias("event_id"), F.col("value").alias("mean"), F.col("value").alias("median"))
    out = features.impute(features.impute(v, "simple_mean", ["mean"]), "simple_median", ["median"])
    return out.select("event_id", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) / CAST(count(*) OVER () AS DOUBLE) AS frequency, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS ordinal FROM customer")
def encode_frequency_ordinal(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("frequency"), F.col("c_mktsegment").alias("ordinal"))
    out = features.encode(features.encode(c, "frequency", "frequency"), "ordinal", "ordinal")
    return out.select("c_custkey", "frequency", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("SELECT c_custkey, round((sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1), 6) AS loo FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def encode_leave_one_out(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("loo"))
    return features.encode(c, "loo", "leave_one_out", "c_acctbal").select("c_custkey", F.round("loo", 6).alias("loo"))


@query("SELECT quality, max(count(*)) OVER () AS n_over, min(count(*)) OVER () AS n_under FROM labels GROUP BY quality")
def balance_counts(spark, sf):
    labels = _t(spark, sf, "labels")
    count = lambda df, n: df.groupBy("quality").agg(F.count("*").alias(n))
    return count(features.balance(labels, "quality", "random_over"), "n_over").join(count(features.balance(labels, "quality", "random_under"), "n_under"), "quality")


@query("SELECT o_orderstatus, count(*) - CAST(round(count(*) * 0.2) AS BIGINT) AS n_train, CAST(round(count(*) * 0.2) AS BIGINT) AS n_test FROM orders GROUP BY 1")
def stratified_split_counts(spark, sf):
    train, test = ml.stratified_split(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")
    count = lambda df, n: df.groupBy("o_orderstatus").agg(F.count("*").alias(n))
    return count(train, "n_train").join(count(test, "n_test"), "o_orderstatus")


# Selection and statistics


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))), 5) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS s, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_returnflag)" for c in _NUM))
def anova_f_scores(spark, sf):
    return select.anova_scores(_t(spark, sf, "lineitem"), list(_NUM), "l_returnflag").select("feature", F.round("f", 5).alias("f"))


@query("""SELECT feature, p, round(least(1.0, min(p * m / i) OVER (ORDER BY p DESC, feature DESC)), 9) AS p_adj FROM
(SELECT *, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM (SELECT p_partkey AS feature, (p_partkey * 7919 % 1000) / 20000.0 AS p FROM part))""")
def bh_adjust(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("feature"), (F.col("p_partkey") * 7919 % 1000 / 20000.0).alias("p"))
    return stats.benjamini_hochberg(p).withColumn("p_adj", F.round("p_adj", 9))


@query("SELECT 'l_quantity' AS variable, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25), 6) AS iqr, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis FROM lineitem")
def summary_stats(spark, sf):
    s = stats.summary_statistics(_t(spark, sf, "lineitem"), ["l_quantity"])
    return s.select("variable", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "iqr", "skewness", "kurtosis")])


def _frame(spark, rows: list[dict]) -> DataFrame:
    """A row a result; numbers as doubles, to six digits behind the point."""
    clean = [{k: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in r.items()} for r in rows]
    kinds = ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in clean[0].items())
    return spark.createDataFrame([tuple(r.values()) for r in clean], kinds)


_TWO = "SELECT l_linestatus AS g, l_extendedprice AS v FROM lineitem"
_AB = f"WITH a AS (SELECT count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM ({_TWO}) WHERE g = 'F'), b AS (SELECT count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM ({_TWO}) WHERE g = 'O')"


@query(f"{_AB} SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), 6) AS statistic, CAST(a.n + b.n - 2 AS DOUBLE) AS df, round((a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)), 6) AS cohens_d FROM a, b")
def ttest_independent(spark, sf):
    r = stats.independent_ttest(_t(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")
    return _frame(spark, [{k: r[k] for k in ("statistic", "df", "cohens_d")}])


@query(f"{_AB} SELECT round((a.m - b.m) / sqrt(a.s / a.n + b.s / b.n), 6) AS statistic, round(pow(a.s / a.n + b.s / b.n, 2) / (pow(a.s / a.n, 2) / (a.n - 1) + pow(b.s / b.n, 2) / (b.n - 1)), 6) AS df FROM a, b")
def ttest_welch(spark, sf):
    r = stats.welch_ttest(_t(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")
    return _frame(spark, [{k: r[k] for k in ("statistic", "df")}])


@query("SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS statistic, CAST(count(*) - 1 AS DOUBLE) AS df FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def ttest_paired(spark, sf):
    r = stats.paired_ttest(_t(spark, sf, "lineitem"), "l_discount", "l_tax")
    return _frame(spark, [{k: r[k] for k in ("statistic", "df")}])


@query("""WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS s FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m, count(*) AS k FROM g)
SELECT round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / (any_value(t.k) - 1) / (sum((g.n - 1) * g.s) / (any_value(t.n) - any_value(t.k))), 6) AS statistic, round(sum(g.n * (g.m - t.m) * (g.m - t.m)) / (sum(g.n * (g.m - t.m) * (g.m - t.m)) + sum((g.n - 1) * g.s)), 6) AS eta_squared FROM g, t""")
def anova_oneway(spark, sf):
    r = stats.one_way_anova(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return _frame(spark, [{k: r[k] for k in ("statistic", "eta_squared")}])


_RANK = "SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS t FROM (SELECT {g} AS g, {v} AS v FROM lineitem)"


@query(f"WITH x AS ({_RANK.format(g='l_returnflag', v='l_quantity')}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM x) SELECT round((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(s * s / c) - 3 * (any_value(n.n) + 1)) / (1 - any_value(n.ties) / (pow(any_value(n.n), 3) - any_value(n.n))), 6) AS statistic FROM (SELECT g, sum(r) AS s, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY g), n")
def kruskal(spark, sf):
    return _frame(spark, [{"statistic": stats.kruskal_wallis(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")["statistic"]}])


@query(f"SELECT CAST(sum(r) - count(*) * (count(*) + 1) / 2 AS DOUBLE) AS statistic FROM ({_RANK.format(g='l_linestatus', v='l_quantity')}) WHERE g = 'F'")
def mannwhitney(spark, sf):
    return _frame(spark, [{"statistic": stats.mann_whitney(_t(spark, sf, "lineitem"), "l_quantity", "l_linestatus")["statistic"]}])


@query("SELECT CAST(least(sum(CASE WHEN s > 0 THEN r END), sum(CASE WHEN s < 0 THEN r END)) AS DOUBLE) AS statistic FROM (SELECT sign(d) AS s, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM (SELECT CAST(l_linenumber AS DOUBLE) - l_quantity / 10 AS d FROM lineitem) WHERE d <> 0)")
def wilcoxon(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("a"), (F.col("l_quantity") / 10).alias("b"))
    return _frame(spark, [{"statistic": stats.wilcoxon_signed_rank(rows, "a", "b")["statistic"]}])


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), g AS (SELECT a, b FROM (SELECT DISTINCT a FROM c), (SELECT DISTINCT b FROM c)), f AS (SELECT g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b), e AS (SELECT *, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM f) SELECT round(sum((n - x) * (n - x) / x), 5) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS dof FROM e")
def chi_square(spark, sf):
    r = stats.chi_square(stats.contingency(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))
    return _frame(spark, [{"statistic": round(r["statistic"], 5), "dof": r["dof"]}])


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, CAST(count(*) AS DOUBLE) AS n FROM lineitem")
def corr_pearson(spark, sf):
    r = stats.correlate_pair(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return _frame(spark, [{k: r[k] for k in ("r", "n")}])


@query("SELECT round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)")
def corr_spearman(spark, sf):
    return _frame(spark, [{"r": stats.correlate_pair(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "spearman")["r"]}])


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem")
def ols_simple(spark, sf):
    r = stats.linear_regression(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    c = r["coefficients"]
    return _frame(spark, [{"intercept": round(c["const"]["coef"], 4), "slope": round(c["l_quantity"]["coef"], 4), "r_squared": r["r_squared"]}])


@query("""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY ALL), b AS (SELECT user_id, v AS base FROM x WHERE d = DATE '2024-01-01'), c AS (SELECT x.d, x.v - base AS change, 100 * (x.v - base) / nullif(base, 0) AS pct FROM x LEFT JOIN b USING (user_id) WHERE x.d <> DATE '2024-01-01')
SELECT d AS "time", count(*) AS n, round(avg(change), 6) AS mean_change, round(stddev_samp(change), 6) AS sd_change, round(avg(pct), 4) AS mean_pct_change FROM c GROUP BY d""")
def change_from_baseline(spark, sf):
    import datetime

    x = _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    s = stats.change_from_baseline(x, "user_id", "d", "v", datetime.date(2024, 1, 1))[1]
    return s.select("time", "n", F.round("mean_change", 6).alias("mean_change"), F.round("sd_change", 6).alias("sd_change"), F.round("mean_pct_change", 4).alias("mean_pct_change"))


_SURV = "SELECT CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS g, l_quantity AS t, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS e FROM lineitem"


def _survival(spark, sf):
    return _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") <= 3, "a").otherwise("b").alias("g"), F.col("l_quantity").alias("t"), (F.col("l_returnflag") == "R").cast("int").alias("e"))


@query(f"""WITH x AS (SELECT g, t, sum(e) AS d, count(*) AS c FROM ({_SURV}) GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM x)
SELECT g AS "group", t, CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS n, round(CASE WHEN max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS survival FROM r WINDOW w AS (PARTITION BY g ORDER BY t)""")
def km_curve(spark, sf):
    k = stats.kaplan_meier(_survival(spark, sf), "t", "e", "g")
    return k.select("group", "t", "d", "n", F.round("survival", 6).alias("survival"))


@query(f"""WITH x AS (SELECT t, sum(e) AS d, count(*) AS c, sum(CASE WHEN g = 'a' THEN e ELSE 0 END) AS da, count(*) FILTER (WHERE g = 'a') AS ca FROM ({_SURV}) GROUP BY t), r AS (SELECT *, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(ca) OVER w AS DOUBLE) AS na FROM x WINDOW w AS (ORDER BY t DESC))
SELECT round(pow(sum(da - d * na / n), 2) / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (na / n) * (1 - na / n) ELSE 0 END), 5) AS statistic FROM r WHERE d > 0""")
def logrank_stat(spark, sf):
    return _frame(spark, [{"statistic": round(stats.logrank_test(_survival(spark, sf), "t", "e", "g")["statistic"], 5)}])


# Clinical helpers and the guide's relational queries


@query("SELECT o_orderkey, x + y AS updrs_part1, y + z AS updrs_motor, x + y + y + z AS updrs_total FROM (SELECT o_orderkey, nullif(o_orderkey % 5, 4) AS x, o_orderkey % 7 AS y, nullif(o_orderkey % 3, 2) AS z FROM orders)")
def updrs_rowsum(spark, sf):
    k = F.col("o_orderkey")
    items = _t(spark, sf, "orders").select("o_orderkey", F.nullif(k % 5, F.lit(4)).alias("x"), (k % 7).alias("y"), F.nullif(k % 3, F.lit(2)).alias("z"))
    return clinical.aggregate_updrs(items, part1=["x", "y"], part3=["y", "z"]).select("o_orderkey", "updrs_part1", "updrs_motor", "updrs_total")


@query("SELECT stage, count(*) AS count, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS proportion, (SELECT median(CAST(p_size % 6 AS DOUBLE)) FROM part) AS median FROM (SELECT CAST(p_size % 6 AS DOUBLE) AS stage FROM part) GROUP BY stage")
def hy_summary(spark, sf):
    h = clinical.hoehn_yahr_summary(_t(spark, sf, "part").select((F.col("p_size") % 6).alias("stage")), "stage")
    return h.select("stage", "count", F.round("proportion", 9).alias("proportion"), "median")


@query("SELECT o_custkey, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice * 0.75 WHEN 'O' THEN o_totalprice * 100 ELSE 0 END), 4) AS total_ledd FROM orders GROUP BY 1")
def ledd_total(spark, sf):
    doses = _t(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "levodopa_cr").when(F.col("o_orderstatus") == "O", "pramipexole").otherwise("unheard_of").alias("drug"), F.col("o_totalprice").alias("dose"))
    return clinical.compute_ledd(doses, by=["o_custkey"])[0].withColumn("total_ledd", F.round("total_ledd", 4))


_DOSES = "SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS e, o_totalprice AS dose FROM orders"


@query(f"WITH x AS ({_DOSES}), t AS (SELECT subject, s AS t FROM x UNION SELECT subject, CAST(e + INTERVAL 1 MONTH AS DATE) FROM x WHERE e IS NOT NULL) SELECT t.subject, t.t, round(coalesce(sum(x.dose), 0), 2) AS total FROM t LEFT JOIN x ON x.subject = t.subject AND x.s <= t.t AND (x.e IS NULL OR x.e >= t.t) GROUP BY 1, 2")
def point_in_time_dose(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("start"), F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), 30)).alias("stop"), F.col("o_totalprice").alias("dose"))
    out = clinical.point_in_time_dose(o)
    return out.withColumn("total", F.round("total", 2) + F.lit(0.0))


@query("""SELECT cohort, subgroup, count(*) AS n FROM (SELECT c_mktsegment AS cohort, CASE WHEN a + b + c > 1 THEN 'Multiple factors' WHEN a = 1 THEN 'LRRK2' WHEN b = 1 THEN 'SNCA' WHEN c = 1 THEN 'GBA' END AS subgroup
FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 5 = 0 AS INT) END AS a, CAST(c_custkey % 7 = 0 AS INT) AS b, CAST(c_custkey % 3 = 0 AS INT) AS c FROM customer)) GROUP BY ALL""")
def case_subgroup_counts(spark, sf):
    k = F.col("c_custkey")
    c = _t(spark, sf, "customer").select("c_mktsegment", F.when(k % 13 != 0, (k % 5 == 0).cast("int")).alias("a"), (k % 7 == 0).cast("int").alias("b"), (k % 3 == 0).cast("int").alias("c"))
    return clinical.subgroup_counts(c, "c_mktsegment", {"LRRK2": "a", "SNCA": "b", "GBA": "c"})


@query("SELECT c_mktsegment, r_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY ALL")
def code_lookup_counts(spark, sf):
    c, n, r = (_t(spark, sf, x) for x in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, (n.n_regionkey == r.r_regionkey) & (r.r_name != "ASIA"), "left")
    return joined.groupBy("c_mktsegment", "r_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, n_name, round(c_acctbal, 1) AS balance, (SELECT min(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey = c_custkey) AS first_visit FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def master_table(spark, sf):
    for name in ("customer", "nation", "orders"):
        _t(spark, sf, name).createOrReplaceTempView(f"m_{name}")
    return spark.sql("SELECT c_custkey, n_name, round(c_acctbal, 1) AS balance, (SELECT min(CAST(o_orderdate AS DATE)) FROM m_orders WHERE o_custkey = c_custkey) AS first_visit FROM m_customer LEFT JOIN m_nation ON c_nationkey = n_nationkey")


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS visit, max(l_quantity) AS worst, round(max(l_extendedprice), 2) AS top FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity IS NOT NULL GROUP BY 1, 2")
def visit_progression(spark, sf):
    o, i, c = (_t(spark, sf, x) for x in ("orders", "lineitem", "customer"))
    joined = o.join(i, (o.o_orderkey == i.l_orderkey) & i.l_quantity.isNotNull()).join(c, o.o_custkey == c.c_custkey)
    return joined.groupBy("o_custkey", F.to_date("o_orderdate").alias("visit")).agg(F.max("l_quantity").alias("worst"), F.round(F.max("l_extendedprice"), 2).alias("top"))


@query("SELECT c_custkey, n_name, o_orderkey, o_totalprice FROM customer, nation, region, orders WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND o_custkey = c_custkey AND o_orderstatus = 'P' AND r_name = 'EUROPE'")
def implicit_join(spark, sf):
    c, n, r, o = (_t(spark, sf, x) for x in ("customer", "nation", "region", "orders"))
    return o.filter("o_orderstatus = 'P'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r.filter("r_name = 'EUROPE'"), n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "o_orderkey", "o_totalprice")


@query("SELECT event_type, count(DISTINCT user_id) AS participants FROM events GROUP BY 1")
def distinct_participants(spark, sf):
    return _t(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("participants"))


@query("SELECT c_nationkey AS nation, 'customer' AS source FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def union_sources(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("source"))
    return c.union(_t(spark, sf, "supplier").select("s_nationkey", F.lit("supplier"))).distinct()


@query("SELECT event_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS x FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM events)")
def carry_forward(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("x"))
    return clinical.carry_forward(e, "user_id", "event_id", ["x"]).select("event_id", "x")


@query("SELECT p_partkey, CASE WHEN s > 180 OR d > 120 THEN 4 WHEN s >= 140 OR d >= 90 THEN 3 WHEN s >= 130 OR d >= 80 THEN 2 WHEN s >= 120 THEN 1 ELSE 0 END AS code FROM (SELECT p_partkey, 90 + p_partkey % 110 AS s, 50 + p_partkey % 83 AS d FROM part)")
def blood_pressure(spark, sf):
    k = F.col("p_partkey")
    return _t(spark, sf, "part").select("p_partkey", cleaners.blood_pressure_code(90 + k % 110, 50 + k % 83).alias("code"))


@query("SELECT p_partkey, strptime(CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') || '/' || CAST(1990 + p_partkey % 30 AS VARCHAR) END, '%m/%Y')::DATE AS d FROM part")
def month_dates(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 4 != 0, F.concat(F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("/"), (1990 + k % 30).cast("string"))).otherwise("no date")
    return _t(spark, sf, "part").select("p_partkey", X.month_date(text).alias("d"))


# Models

_RULE = "SELECT CAST(quality AS INT) AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id)"


def _rule(spark, sf):
    j = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("quality").cast("int").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"), F.col("n_chars").cast("double").alias("s"))


@query(f"SELECT y AS label, p AS prediction, count(*) AS n FROM ({_RULE}) GROUP BY ALL")
def confusion_matrix(spark, sf):
    return ml.confusion(_rule(spark, sf), "y", "p")


@query(f"""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(y * p) AS DOUBLE) AS tp, CAST(sum((1 - y) * (1 - p)) AS DOUBLE) AS tn, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(p) AS DOUBLE) AS pp FROM ({_RULE}))
SELECT round((tp + tn) / n, 6) AS accuracy, round(((tp + tn) / n - (pos * pp + (n - pos) * (n - pp)) / (n * n)) / (1 - (pos * pp + (n - pos) * (n - pp)) / (n * n)), 6) AS kappa, round((tp * n - pos * pp) / sqrt(pos * (n - pos) * pp * (n - pp)), 6) AS mcc FROM c""")
def metric_table(spark, sf):
    m = ml.metrics_from_counts({(r.label, r.prediction): r.n for r in ml.confusion(_rule(spark, sf), "y", "p").collect()})
    return _frame(spark, [{"accuracy": m["Accuracy"], "kappa": m["Kappa"], "mcc": m["MCC"]}])


@query(f"SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ({_RULE}))")
def auc_rank(spark, sf):
    return _frame(spark, [{"auc": stats.rank_auc(_rule(spark, sf), "s", "y")}])


def _model_rows(spark, sf):
    i = _t(spark, sf, "lineitem")
    return i.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_quantity") + 100 * F.col("l_discount") > 32, "high").otherwise("low").alias("COHORT"))


@query()
def leaderboard(spark, sf):
    c = ml.Classifier()
    c.setup_experiment(_model_rows(spark, sf), "COHORT", folds=2)
    c.compare_models(include=["lr", "dt", "nb"])
    return _frame(spark, [{k: v for k, v in r.items() if k != "TT (Sec)"} for r in c.leaderboard])


@query()
def predict_scores(spark, sf):
    c = ml.Classifier()
    c.setup_experiment(_model_rows(spark, sf), "COHORT")
    return c.predict_model(c.create_model("lr"))


@query()
def feature_selection_fdr(spark, sf):
    rows = _model_rows(spark, sf).withColumn("y", (F.col("COHORT") == "high").cast("int"))
    s = select.FeatureSelector("fdr").fit(rows, list(_NUM), "y")
    return spark.createDataFrame([(c,) for c in s.selected], "feature string")


@query()
def pca_plane(spark, sf):
    return ml.pca2(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_NUM), list(_NUM))


@query()
def permutation_importance(spark, sf):
    rows = _model_rows(spark, sf).withColumn("y", (F.col("COHORT") == "high").cast("int"))
    effects = select.permutation_effects(rows, list(_NUM), "y")
    return _frame(spark, [{"feature": c, "effect": e} for c, e in zip(_NUM, effects, strict=True)])


@query()
def mixed_model(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.dayofmonth("ts").alias("day"), "value")
    r = stats.linear_mixed_model(e, "value", ["day"], "user_id", iterations=50)
    return _frame(spark, [{"term": k, **v} for k, v in r["coefficients"].items()])
