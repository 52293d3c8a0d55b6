"""More registered queries: cleaners, column rules, encodings, selection, p-values and adjustments, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaners
from ..functions import scalar as X
from ..model import ReducerConfig, Study
from ..operators import clinical, features, ml, neighbours, reduce, select, stats
from ..sources import io
from .catalogue import _SURV, _frame, _survival, _t, _visits, oracle_sql, queries, query  # noqa: F401  the registry is one


# Distribution functions in SQL: a series for the normal, closed forms for few degrees of freedom, a sum for Student's t.


def _normal_two_sided(z: str) -> str:
    x = f"least(abs({z}) / sqrt(2.0), 4.0)"
    return f"greatest(0.0, 1 - 2 / sqrt(pi()) * list_sum([pow(-1, k) * pow({x}, 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)) for k in range(0, 100)]))"


def _t_two_sided(t: str, df: str, n: int = 40_000) -> str:
    area = lambda low: f"((pi() / 2 - {low}) * list_avg([exp(({df} - 1) * ln(cos({low} + (k + 0.5) / {n} * (pi() / 2 - {low})))) for k in range(0, {n})]))"
    return f"({area(f'atan(abs({t}) / sqrt({df}))')} / {area('0.0')})"


def _labels(spark, pairs: list[tuple[str, float]], key: str = "feature", value: str = "score") -> DataFrame:
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in pairs], f"{key} string, {value} double")


# Cleaners


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 2 THEN 0.5 ELSE CAST(p_size % 4 AS DOUBLE) END AS FEATBRADY, CASE WHEN p_size % 3 = 2 THEN 0.5 ELSE CAST(p_size % 3 AS DOUBLE) END AS FEATTREMOR, p_size % 5 AS other FROM part")
def clean_parkinsonism_features(spark, sf):
    n = F.col("p_size")
    return cleaners.clean_features_of_parkinsonism(_t(spark, sf, "part").select("p_partkey", (n % 4).alias("FEATBRADY"), (n % 3).alias("FEATTREMOR"), (n % 5).alias("other")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 0.5 ELSE CAST(p_size % 3 AS DOUBLE) END AS ABNORM1, p_size AS other FROM part")
def clean_physical_exam(spark, sf):
    return cleaners.clean_gen_physical_exam(_t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3).alias("ABNORM1"), F.col("p_size").alias("other")))


@query("SELECT p_partkey, nullif(CASE WHEN p_size % 6 = 0 THEN 101 ELSE p_size % 5 END, 101) AS NP3GAIT, CASE WHEN p_size % 6 = 1 THEN 101 ELSE p_size % 5 END AS NP2GAIT FROM part")
def unable_to_rate(spark, sf):
    n = F.col("p_size")
    raw = _t(spark, sf, "part").select("p_partkey", F.when(n % 6 == 0, 101).otherwise(n % 5).alias("NP3GAIT"), F.when(n % 6 == 1, 101).otherwise(n % 5).alias("NP2GAIT"))
    return cleaners.unable_to_rate(raw)


_MONTHS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in cleaners.VISIT_MONTHS.items())


@query(f"SELECT o_orderkey, visit, CASE visit {_MONTHS} END AS months FROM (SELECT o_orderkey, CASE o_orderkey % 22 WHEN 0 THEN 'SC' WHEN 1 THEN 'BL' WHEN 21 THEN NULL ELSE 'V' || lpad(CAST(o_orderkey % 22 - 1 AS VARCHAR), 2, '0') END AS visit FROM orders)")
def visit_months(spark, sf):
    k = F.col("o_orderkey") % 22
    visit = F.when(k == 0, "SC").when(k == 1, "BL").when(k != 21, F.concat(F.lit("V"), F.lpad((k - 1).cast("string"), 2, "0")))
    return _t(spark, sf, "orders").select("o_orderkey", visit.alias("visit")).withColumn("months", cleaners.event_id_to_months(F.col("visit")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) WHEN o_orderkey % 3 = 1 THEN r_regionkey ELSE c END AS CMINDC, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ' ' || lower(r_name) ELSE r_name END AS CMINDC_TEXT,
CAST(strptime('01/' || CAST(1990 + o_orderkey % 20 AS VARCHAR), '%m/%Y') AS DATE) AS STARTDT FROM (SELECT o_orderkey, o_orderkey % 5 AS c FROM orders) LEFT JOIN (SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region) ON c = r_regionkey""")
def concomitant_meds(spark, sf):
    """A third of the rows has neither, a third a text for the code, a third a code for the text."""
    region = _t(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("code"), F.col("r_name").alias("text"))
    o = _t(spark, sf, "orders").withColumn("c", F.col("o_orderkey") % 5)
    k = F.col("o_orderkey") % 3
    named = o.join(F.broadcast(region), o.c == region.code, "left")  # region: five rows
    raw = named.select("o_orderkey", F.when(k == 2, F.col("c")).alias("CMINDC"), F.when(k == 1, F.concat(F.lit(" "), F.lower("text"))).alias("CMINDC_TEXT"), F.concat(F.lit("01/"), (1990 + F.col("o_orderkey") % 20).cast("string")).alias("STARTDT"))
    return cleaners.clean_concomitant_meds(raw, region)


@query("""SELECT p_partkey, "Sup BP code", CASE "Sup BP code" WHEN 0 THEN 'normal' WHEN 1 THEN 'elevated' WHEN 2 THEN 'stage 1' WHEN 3 THEN 'stage 2' WHEN 4 THEN 'crisis' END AS "Sup BP label" FROM
(SELECT p_partkey, CASE WHEN s IS NULL THEN NULL WHEN s > 180 OR d > 120 THEN 4 WHEN s >= 140 OR d >= 90 THEN 3 WHEN s >= 130 OR d >= 80 THEN 2 WHEN s >= 120 THEN 1 ELSE 0 END AS "Sup BP code" FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 90 + p_partkey % 110 END AS s, 50 + p_partkey % 83 AS d FROM part))""")
def clean_by_table_name(spark, sf):
    """The dispatch finds the cleaner of vital signs by the table's name and leaves the other table alone."""
    k = F.col("p_partkey")
    vital = _t(spark, sf, "part").select("p_partkey", F.when(k % 9 != 0, 90 + k % 110).alias("SYSSUP"), (50 + k % 83).alias("DIASUP"))
    study = cleaners.clean(Study.of({"medical_history": {"Vital_Signs": vital, "Other": vital}}))
    cleaned, other = study.tables.values()
    return cleaned.drop("SYSSUP", "DIASUP") if other.columns == vital.columns else other


# Column rules


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def apply_drops(spark, sf):
    study = Study.of({"items": _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")})
    return next(iter(reduce.apply_drops(study, {"items": ["l_tax", "l_discount", "unheard_of"], "no_table": ["x"]}).tables.values()))


@query("SELECT o_orderkey, o_custkey FROM orders")
def leakage_drop(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("UPDRS"), F.col("o_totalprice").alias("mod_UPDRS"), F.col("o_orderkey").alias("UPDRS_high"))
    return reduce.drop_leakage(o, ["UPDRS", "unheard_of"])


@query("SELECT o_orderkey, o_custkey, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'mild' ELSE 'severe' END AS stage FROM orders")
def remap_labels(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("stage"))
    return reduce.remap_numeric_labels(o, "stage", {0: "none", 1: "mild", 2: "severe"})


@query("SELECT coalesce(s, 0) AS s, coalesce(n, 0) AS n, y FROM (SELECT CASE WHEN p_size % 5 <> 0 THEN p_size END AS s, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS n, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS y FROM part) WHERE y IS NOT NULL")
def selection_input(spark, sf):
    """Rows without a target go, keys and text features go, missing numbers are 0."""
    p = _t(spark, sf, "part").select(F.col("p_partkey").alias("PATNO"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("s"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("n"), "p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_brand")).alias("y"))
    _, names = reduce.key_feature_split(p, "y")
    rows = p.filter("y is not null").select(*names, "y")
    return reduce.select_existing(reduce.drop_non_numeric(rows, ["y"]).fillna(0), ["s", "n", "y", "unheard_of"])


@query("SELECT 'train' AS _original_split, o_orderkey, o_custkey, o_totalprice AS price FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'test', o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 4 = 0")
def stack_splits(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return reduce.stack_splits(o.filter("o_orderkey % 4 <> 0"), o.filter("o_orderkey % 4 = 0").drop("price"))


@query("""SELECT x.name AS "column", 'high_cardinality' AS reason FROM (SELECT 'p_name' AS name, count(DISTINCT p_name) / CAST(count(*) AS DOUBLE) AS r, avg(length(p_name)) AS len, 0 AS num FROM part UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) / CAST(count(*) AS DOUBLE), avg(length(p_brand)), 0 FROM part
UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) / CAST(count(*) AS DOUBLE), 99, 1 FROM part UNION ALL SELECT 'p_size', count(DISTINCT p_size) / CAST(count(*) AS DOUBLE), 99, 1 FROM part) x WHERE r > 0.9 AND (num = 1 OR len > 10)""")
def high_cardinality(spark, sf):
    return reduce.drop_suggestions(_t(spark, sf, "part").select("p_name", "p_brand", "p_partkey", "p_size"), ReducerConfig().override(check_cardinality=True))


@query("SELECT a AS \"table\", n AS n_rows, k AS n_columns, m AS n_numeric, s AS n_string, round(100.0 * x / (n * k), 6) AS null_pct FROM (SELECT 'part' AS a, count(*) AS n, 3 AS k, 2 AS m, 1 AS s, count(*) - count(CASE WHEN p_size % 5 <> 0 THEN 1 END) AS x FROM part UNION ALL SELECT 'nation', count(*), 3, 2, 1, 0 FROM nation)")
def study_summary_full(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"))
    return reduce.study_summary(Study.of({"part": part, "nation": _t(spark, sf, "nation")})).withColumn("null_pct", F.round("null_pct", 6))


@query("SELECT p_partkey, CASE WHEN p_partkey % 20 <> 0 THEN (p_size + p_size % 3) / 2.0 END AS mostly, p_brand AS seldom, CAST(p_size AS VARCHAR) AS VISIT_DATE FROM part")
def coerce_numeric(spark, sf):
    """More than 90 % of the values read as numbers; half of the other column's do not; dates and keys are left alone."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = _t(spark, sf, "part").select("p_partkey", F.when(k % 20 != 0, F.concat_ws("|", n.cast("string"), (n % 3).cast("string"))).otherwise("no number").alias("mostly"), F.col("p_brand").alias("seldom"), n.cast("string").alias("VISIT_DATE"))
    return X.coerce_numeric_majority(p)


# Features


@query("SELECT p_partkey, round(CASE WHEN v >= 0 THEN (pow(v + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - v, 1.5) - 1) / 1.5 END, 6) AS yeo, round((pow(p_retailprice, 0.5) - 1) / 0.5, 6) AS box FROM (SELECT p_partkey, p_retailprice, CAST(p_size - 25 AS DOUBLE) AS v FROM part)")
def power_transform(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25).cast("double").alias("v"), "p_retailprice")
    return p.select("p_partkey", F.round(features.power(F.col("v"), 0.5, True), 6).alias("yeo"), F.round(features.power(F.col("p_retailprice"), 0.5), 6).alias("box"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS c, l_quantity AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((coalesce(sum(y) OVER w, 0) + (SELECT avg(l_quantity) FROM lineitem)) / (count(y) OVER w + 1), 6) AS code FROM r WINDOW w AS (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def encode_catboost(spark, sf):
    i = _t(spark, sf, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = features.encode(i.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("code"), F.col("l_quantity").alias("y"), order.alias("at")), "code", "catboost", "y", order_by="at")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("code", 6).alias("code"))


@query("SELECT p_partkey, a, b, a + b AS a_plus_b, a - b AS a_minus_b, a * b AS a_times_b, a / nullif(b, 0) AS a_over_b FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 3 AS DOUBLE) AS b FROM part)")
def feature_interactions(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 3).cast("double").alias("b"))
    return features.interactions(p, "auto", ["a", "b"])


@query("SELECT p_partkey, a, b, a * b AS \"a b\" FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 3 AS DOUBLE) AS b FROM part)")
def polynomial_interactions(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 3).cast("double").alias("b"))
    return features.interactions(p, "polynomial", ["a", "b"])


@query("SELECT p_partkey, p_size * 2 + 1 AS p_size FROM part")
def custom_transform(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", "p_size")
    return features.transform_column(features.transform_column(p, "p_size", lambda c: c * 2 + 1), "p_size", lambda c: c + 1 / 0)


@query("SELECT p_partkey, coalesce(v, (SELECT median(CAST(p_size AS DOUBLE)) FROM part WHERE p_partkey % 4 <> 0)) AS v FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS v FROM part)")
def impute_auto(spark, sf):
    return features.impute(_t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("double")).alias("v")), "auto", ["v"])


@query("SELECT CAST(3 AS BIGINT) AS steps, count(DISTINCT o_orderpriority) + 2 AS new_features, 3 + count(DISTINCT o_orderpriority) + 2 AS columns FROM orders")
def engineer_summary(spark, sf):
    """The chain's own count of what it added: a column for each value in the table, a square and a root."""
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("kind"))
    e = features.FeatureEngineer(o).one_hot_encode(columns=["kind"]).engineer_polynomial_features(["o_custkey"]).apply_custom_transformation("o_totalprice", F.sqrt, "root")
    s = e.summary()
    return spark.createDataFrame([(len(s["steps"]), s["new_features"], s["columns"])], "steps bigint, new_features bigint, columns bigint")


# Selection

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_f_score = lambda group: " UNION ALL ".join(f"SELECT '{c}' AS feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) AS s, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY {group})" for c in _FEATURES)
_THIRD = "CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END"


@query(f"SELECT feature FROM ({_f_score('l_returnflag')}) ORDER BY f DESC LIMIT 2")
def select_k_best(spark, sf):
    s = select.FeatureSelector("k_best", param=2).fit(_t(spark, sf, "lineitem"), list(_FEATURES), "l_returnflag")
    return spark.createDataFrame([(c,) for c in s.selected], "feature string")


@query(f"""WITH s AS (SELECT feature, pow((SELECT count(*) - 3 FROM lineitem) / ((SELECT count(*) - 3 FROM lineitem) + 2 * f), (SELECT count(*) - 3 FROM lineitem) / 2.0) AS p FROM ({_f_score(_THIRD)})), r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS i FROM s)
SELECT feature FROM (SELECT feature, min(p * 4 / i) OVER (ORDER BY i DESC) AS a FROM r) WHERE a <= 0.05""")
def select_fdr(spark, sf):
    i = _t(spark, sf, "lineitem").withColumn("third", F.expr(_THIRD))
    s = select.FeatureSelector("fdr", param=0.05).fit(i, list(_FEATURES), "third")
    return spark.createDataFrame([(c,) for c in s.selected], "feature string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) AS score FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def f_regression_scores(spark, sf):
    s = select.scored(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "regression")
    return _labels(spark, [(k, round(v[0], 4)) for k, v in s.items()])


@query("SELECT 'size' AS feature UNION ALL SELECT 'holes'")
def varying_columns(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_size").alias("size"), F.lit(1).alias("constant"), F.when(F.col("p_partkey") % 2 == 0, 5).alias("holes"), F.lit(None).cast("int").alias("nothing"))
    return spark.createDataFrame([(c,) for c in select.varying(p, p.columns)], "feature string")


# Statistics with their p-values

_G3 = "WITH g AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS s FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS m FROM g), a AS (SELECT sum(g.n * (g.m - t.m) * (g.m - t.m)) / 2 / (sum((g.n - 1) * g.s) / (any_value(t.n) - 3)) AS f, any_value(t.n) - 3 AS d FROM g, t)"


@query(f"{_G3} SELECT CAST(2 AS DOUBLE) AS df_between, d AS df_within, round(pow(d / (d + 2 * f), d / 2), 6) AS p_value FROM a")
def anova_p(spark, sf):
    r = stats.one_way_anova(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return _frame(spark, [{k: r[k] for k in ("df_between", "df_within", "p_value")}])


_RANKS = "SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY v) AS t FROM (SELECT {g} AS g, {v} AS v FROM lineitem)"
_N = "n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM x)"


@query(f"WITH x AS ({_RANKS.format(g='l_returnflag', v='l_quantity')}), {_N} SELECT round(exp(-h / 2), 6) AS p_value, CAST(2 AS DOUBLE) AS df FROM (SELECT (12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(s * s / c) - 3 * (any_value(n.n) + 1)) / (1 - any_value(n.ties) / (pow(any_value(n.n), 3) - any_value(n.n))) AS h FROM (SELECT g, sum(r) AS s, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY g), n)")
def kruskal_p(spark, sf):
    r = stats.kruskal_wallis(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return _frame(spark, [{k: r[k] for k in ("p_value", "df")}])


@query(f"""WITH x AS ({_RANKS.format(g='l_linestatus', v='l_quantity')}), {_N}, s AS (SELECT sum(r) AS r, CAST(count(*) AS DOUBLE) AS a, any_value(n.n) - count(*) AS b, any_value(n.n) AS n, any_value(n.ties) AS ties FROM x, n WHERE g = 'F'),
z AS (SELECT a, b, (abs(r - a * (a + 1) / 2 - a * b / 2) - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM s) SELECT a AS n_a, b AS n_b, round({_normal_two_sided('z')}, 5) AS p_value, (SELECT median(l_quantity) FROM lineitem WHERE l_linestatus = 'F') AS median_a FROM z""")
def mannwhitney_p(spark, sf):
    r = stats.mann_whitney(_t(spark, sf, "lineitem"), "l_quantity", "l_linestatus")
    return _frame(spark, [{"n_a": r["n_a"], "n_b": r["n_b"], "p_value": round(r["p_value"], 5), "median_a": r["median_a"]}])


_PAIRS = "SELECT CAST(p_size AS DOUBLE) - (p_partkey % 51) AS d FROM part"


@query(f"""WITH x AS (SELECT sign(d) AS s, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS t FROM ({_PAIRS}) WHERE d <> 0), w AS (SELECT least(sum(CASE WHEN s > 0 THEN r END), sum(CASE WHEN s < 0 THEN r END)) AS w, CAST(count(*) AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM x),
z AS (SELECT n, (n * (n + 1) / 4 - w) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w) SELECT n, round({_normal_two_sided('z')}, 5) AS p_value FROM z""")
def wilcoxon_p(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 51).cast("double").alias("b"))
    r = stats.wilcoxon_signed_rank(p, "a", "b")
    return _frame(spark, [{"n": r["n"], "p_value": round(r["p_value"], 5)}])


@query(f"""WITH a AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS s FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS s FROM customer WHERE c_custkey % 2 = 1),
t AS (SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)) AS d, a.m AS ma, b.m AS mb FROM a, b)
SELECT round({_t_two_sided('t', 'df')}, 4) AS p_value, round(d * (1 - 3 / (4 * (df + 2) - 9)), 6) AS hedges_g, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b FROM t""")
def ttest_p(spark, sf):
    c = _t(spark, sf, "customer").select("c_acctbal", (F.col("c_custkey") % 2).alias("g"))
    r = stats.independent_ttest(c, "c_acctbal", "g")
    return _frame(spark, [{"p_value": round(r["p_value"], 4), "hedges_g": r["hedges_g"], "mean_a": r["mean_a"], "mean_b": r["mean_b"]}])


@query(f"WITH t AS (SELECT avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, avg(d) AS m, avg(d) / stddev_samp(d) AS e FROM ({_PAIRS})) SELECT round({_t_two_sided('t', 'df')}, 4) AS p_value, round(m, 6) AS mean_difference, round(e, 6) AS cohens_d FROM t")
def ttest_paired_p(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 51).cast("double").alias("b"))
    r = stats.paired_ttest(p, "a", "b")
    return _frame(spark, [{"p_value": round(r["p_value"], 4), "mean_difference": r["mean_difference"], "cohens_d": r["cohens_d"]}])


@query("""WITH g AS (SELECT l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS s FROM lineitem GROUP BY 1), e AS (SELECT sum((n - 1) * s) / (sum(n) - 3) AS mse FROM g)
SELECT a.k AS group_a, b.k AS group_b, round(b.m - a.m, 6) AS difference, round(abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 4) AS q FROM g a JOIN g b ON a.k < b.k, e""")
def tukey_pairs(spark, sf):
    """The studentised range between groups, from the width of the intervals and their common critical value."""
    from ..functions import special

    i = _t(spark, sf, "lineitem")
    crit = special.studentized_range_ppf(0.95, 3, i.count() - 3)
    rows = stats.tukey_hsd(i, "l_quantity", "l_returnflag")
    return _frame(spark, [{"group_a": r["group_a"], "group_b": r["group_b"], "difference": r["difference"], "q": round(abs(r["difference"]) / ((r["ci_high"] - r["difference"]) / crit), 4)} for r in rows])


@query(f"""WITH x AS ({_RANKS.format(g='l_returnflag', v='l_quantity')}), {_N}, s AS (SELECT g, avg(r) AS r, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY g), z AS (SELECT a.g AS group_a, b.g AS group_b, (a.r - b.r) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.c + 1 / b.c)) AS z FROM s a JOIN s b ON a.g < b.g, n),
p AS (SELECT *, {_normal_two_sided('z')} AS p FROM z), h AS (SELECT *, row_number() OVER (ORDER BY p) AS i FROM p) SELECT group_a, group_b, round(z, 5) AS z, round(p, 5) AS p_value, round(least(1.0, max(p * (4 - i)) OVER (ORDER BY i)), 5) AS p_adj FROM h""")
def dunn_pairs(spark, sf):
    rows = stats.dunn_posthoc(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")
    return _frame(spark, [{"group_a": r["group_a"], "group_b": r["group_b"]} | {k: round(r[k], 5) for k in ("z", "p_value", "p_adj")} for r in rows])


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM c)
SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic, round(exp(-sum((n - e) * (n - e) / e) / 2), 6) AS p_value, CAST(2 AS DOUBLE) AS dof FROM e""")
def chi_square_p(spark, sf):
    r = stats.chi_square(stats.contingency(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))
    return _frame(spark, [{k: r[k] for k in ("statistic", "p_value", "dof")}])


_FOUR = "WITH c AS (SELECT CAST(sum(CAST(p_size % 3 = 0 AND p_partkey % 2 = 0 AS INT)) AS DOUBLE) AS a, CAST(sum(CAST(p_size % 3 = 0 AND p_partkey % 2 = 1 AS INT)) AS DOUBLE) AS b, CAST(sum(CAST(p_size % 3 <> 0 AND p_partkey % 2 = 0 AS INT)) AS DOUBLE) AS c, CAST(sum(CAST(p_size % 3 <> 0 AND p_partkey % 2 = 1 AS INT)) AS DOUBLE) AS d FROM part)"


def _four(spark, sf) -> list[list[int]]:
    size, key = F.col("p_size") % 3 == 0, F.col("p_partkey") % 2 == 0
    r = _t(spark, sf, "part").agg(F.count_if(size & key), F.count_if(size & ~key), F.count_if(~size & key), F.count_if(~size & ~key)).first()
    return [[r[0], r[1]], [r[2], r[3]]]


@query(f"""{_FOUR}, k AS (SELECT *, unnest(range(CAST(greatest(0, a - d) AS BIGINT), CAST(least(a + b, a + c) AS BIGINT) + 1)) AS x FROM c),
l AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS q FROM k)
SELECT round(any_value(a * d / (b * c)), 6) AS odds_ratio, round(sum(CASE WHEN q <= o + 1e-7 THEN exp(q) ELSE 0 END), 6) AS p_value FROM l, (SELECT q AS o FROM l WHERE x = a)""")
def fisher_exact(spark, sf):
    return _frame(spark, [stats.fisher_exact(_four(spark, sf))])


@query(f"""{_FOUR}, k AS (SELECT b, c, least(b, c) AS m, unnest(range(0, CAST(least(b, c) AS BIGINT) + 1)) AS x FROM c)
SELECT any_value(m) AS statistic, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(x + 1) - lgamma(b + c - x + 1) - (b + c) * ln(2)))), 6) AS p_value FROM k""")
def mcnemar_exact(spark, sf):
    (_, b), (c, _) = _four(spark, sf)
    return _frame(spark, [stats.mcnemar(b, c)])


@query(f"{_FOUR} SELECT round(ln(a * d / (b * c)), 5) AS coef, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) AS se, round(a * d / (b * c), 5) AS odds_ratio, round(exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)), 5) AS or_low FROM c")
def logistic_binary(spark, sf):
    """With one binary predictor the fit has a closed form: the odds ratio of the four counts."""
    p = _t(spark, sf, "part").select((F.col("p_size") % 3 == 0).cast("double").alias("x"), (F.col("p_partkey") % 2 == 0).cast("double").alias("y"))
    r = stats.logistic_regression(p, "y", ["x"])["coefficients"]["x"]
    return _frame(spark, [{k: round(r[k], 5) for k in ("coef", "se", "odds_ratio", "or_low")}])


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz, CAST(count(*) AS DOUBLE) AS n FROM lineitem), r AS (SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c)
SELECT round(r, 6) AS r, n, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 4)), 6) AS ci_low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 4)), 6) AS ci_high FROM r""")
def partial_corr(spark, sf):
    r = stats.partial_correlation(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_discount"])
    return _frame(spark, [{k: r[k] for k in ("r", "n", "ci_low", "ci_high")}])


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(_FEATURES) for b in _FEATURES[k + 1 :]))
def corr_matrix(spark, sf):
    m = stats.correlation_matrix(_t(spark, sf, "lineitem"), list(_FEATURES))
    return _frame(spark, [{"x": a, "y": b, "r": m["r"][i][j]} for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES) if i < j])


_P = "SELECT s_suppkey AS k, CAST((s_suppkey * 7919 % 1000 + 1) / 40000.0 AS DOUBLE) AS p, row_number() OVER (ORDER BY s_suppkey * 7919 % 1000, s_suppkey) AS i, CAST(count(*) OVER () AS DOUBLE) AS m FROM supplier"


@query(f"""SELECT k, round(least(1.0, p * m), 9) AS bonferroni, round(1 - pow(1 - p, m), 9) AS sidak, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY i)), 9) AS holm, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 9) AS fdr_bh,
round(least(1.0, min(p * m / i * (SELECT sum(1.0 / i) FROM ({_P}))) OVER (ORDER BY i DESC)), 9) AS fdr_by,
round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)) * CASE WHEN r1 IN (0, m) THEN 1 ELSE (m - r1) / m END, 9) AS fdr_tsbh
FROM ({_P}), (SELECT count(*) FILTER (a <= 0.05) AS r1 FROM (SELECT min(p * m / i) OVER (ORDER BY i DESC) AS a FROM ({_P})))""")
def adjust_p_values(spark, sf):
    """All six adjustments of one column. The first stage of the two-stage one rejects the p whose adjusted value is at most 0.05."""
    out = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 7919 % 1000 + 1) / 40000.0).alias("p"))
    for name in stats.ADJUSTMENTS:
        out = stats.adjust_column(out, "p", name).withColumnRenamed("p_adj", name)
    return out.select("k", *[F.round(n, 9).alias(n) for n in stats.ADJUSTMENTS])


@query("""SELECT 'a' AS "column", count(*) - count(a) AS n_missing, round(100.0 * (count(*) - count(a)) / count(*), 6) AS pct_missing FROM (SELECT CASE WHEN p_size % 5 <> 0 THEN 1 END AS a FROM part) UNION ALL SELECT 'b', count(*) - count(a), round(100.0 * (count(*) - count(a)) / count(*), 6) FROM (SELECT CASE WHEN p_size % 7 <> 0 THEN 1 END AS a FROM part)""")
def missingness(spark, sf):
    n = F.col("p_size")
    r = stats.missingness_report(_t(spark, sf, "part").select(F.when(n % 5 != 0, 1).alias("a"), F.when(n % 7 != 0, 1).alias("b")))
    return spark.createDataFrame([(c, x["n_missing"], round(x["pct_missing"], 6)) for c, x in r["columns"].items()], "column string, n_missing bigint, pct_missing double")


@query("SELECT round(regr_slope(z, x), 6) AS coef, round(regr_r2(z, x), 6) AS r_squared FROM (SELECT l_extendedprice AS z, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_samp(l_quantity) FROM lineitem) AS x FROM lineitem)")
def ols_standardised(spark, sf):
    r = stats.linear_regression(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], standardize=True)
    return _frame(spark, [{"coef": r["coefficients"]["l_quantity"]["coef"], "r_squared": r["r_squared"]}])


@query(f"""WITH s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM (SELECT c_acctbal AS y, CAST(c_custkey % 97 AS DOUBLE) AS x FROM customer)), t AS (SELECT *, b / sqrt(syy * (1 - r2) / (n - 2) / sxx) AS t FROM s)
SELECT round(b, 6) AS coef, round(b / t, 6) AS se, round(t, 6) AS t, round({_t_two_sided('t', 'CAST(n - 2 AS DOUBLE)')}, 4) AS p_value, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r_squared, round(t * t, 5) AS f_statistic FROM t""")
def ols_inference(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 97).cast("double").alias("x"))
    r = stats.linear_regression(c, "y", ["x"])
    x = r["coefficients"]["x"]
    return _frame(spark, [{"coef": x["coef"], "se": x["se"], "t": x["t"], "p_value": round(x["p_value"], 4), "adj_r_squared": r["adj_r_squared"], "f_statistic": round(r["f_statistic"], 5)}])


@query("""WITH f AS (SELECT regr_slope(c_acctbal, CAST(c_custkey % 97 AS DOUBLE)) AS b, regr_intercept(c_acctbal, CAST(c_custkey % 97 AS DOUBLE)) AS a FROM customer), r AS (SELECT c_acctbal - a - b * (c_custkey % 97) AS r, lag(c_acctbal - a - b * (c_custkey % 97)) OVER (ORDER BY c_custkey) AS p FROM customer, f)
SELECT round(sum((r - p) * (r - p)) / sum(r * r), 6) AS durbin_watson FROM r""")
def durbin_watson(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_acctbal").alias("y"), (F.col("c_custkey") % 97).cast("double").alias("x"), F.col("c_custkey").cast("double").alias("k"))
    return _frame(spark, [{"durbin_watson": stats.linear_regression(c, "y", ["x"], order_by="k")["durbin_watson"]}])


@query("""WITH r AS (SELECT l_linenumber % 2 AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), w AS (SELECT g, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r GROUP BY g), p AS (SELECT sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy, sum(n) - 3 AS df FROM w), a AS (SELECT regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss FROM r)
SELECT 'g' AS term, round((a.rss - (syy - sxy * sxy / sxx)) / ((syy - sxy * sxy / sxx) / df), 4) AS f FROM a, p UNION ALL SELECT 'x', round(sxy * sxy / sxx / ((syy - sxy * sxy / sxx) / df), 4) FROM p""")
def ancova_table(spark, sf):
    i = _t(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return _frame(spark, [{"term": r["term"], "f": round(r["F"], 4)} for r in stats.ancova(i, "y", "g", ["x"]) if r["F"] is not None])


_SURV3 = "SELECT CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS g, l_quantity AS t, CAST(l_returnflag = 'R' AS INT) AS e FROM lineitem"


@query(f"""WITH x AS (SELECT g, t, CAST(sum(e) AS DOUBLE) AS d, count(*) AS c FROM ({_SURV3}) GROUP BY ALL), r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS DOUBLE) AS n FROM x),
s AS (SELECT g, t, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w AS ls, sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER w AS v, max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w AS dead FROM r WINDOW w AS (PARTITION BY g ORDER BY t))
SELECT g AS "group", t, CASE WHEN dead = 0 THEN round(pow(exp(ls), exp(1.959963984540054 * sqrt(v) / abs(nullif(ls, 0)))), 6) END AS ci_low, CASE WHEN dead = 0 THEN round(pow(exp(ls), exp(-1.959963984540054 * sqrt(v) / abs(nullif(ls, 0)))), 6) END AS ci_high FROM s""")
def km_intervals(spark, sf):
    k = stats.kaplan_meier(_survival(spark, sf), "t", "e", "g")
    return k.select("group", "t", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


# Pairs in and out of order; Cox regression


def _tau_sql(name: str, x: str, y: str, table: str) -> str:
    tie = lambda c: f"(SELECT sum(t * (t - 1) / 2) AS t0, sum(t * (t - 1) * (t - 2)) AS t1, sum(t * (t - 1) * (2 * t + 5)) AS t2 FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM {table} GROUP BY {c}))"
    return f"""SELECT '{name}' AS pair, CAST(n AS BIGINT) AS n, round(s / sqrt((n * (n - 1) / 2 - xt.t0) * (n * (n - 1) / 2 - yt.t0)), 9) AS tau,
round({_normal_two_sided("s / sqrt((n * (n - 1) * (2 * n + 5) - xt.t2 - yt.t2) / 18 + 2 * xt.t0 * yt.t0 / (n * (n - 1)) + xt.t1 * yt.t1 / (9 * n * (n - 1) * (n - 2)))")}, 6) AS p_value
FROM (WITH c AS (SELECT {x} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS c FROM {table} GROUP BY ALL) SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
(SELECT CAST(count(*) AS DOUBLE) AS n FROM {table}), {tie(x)} xt, {tie(y)} yt"""


@query(" UNION ALL ".join(_tau_sql(*x) for x in (("quantity, discount", "l_quantity", "l_discount", "lineitem"), ("balance, nation", "c_acctbal", "c_nationkey", "customer"))))
def kendall_tau(spark, sf):
    """Tau-b and its p: a table of many ties, and one of many values. The SQL takes all pairs of cells."""
    found = []
    for name, table, x, y in (("quantity, discount", "lineitem", "l_quantity", "l_discount"), ("balance, nation", "customer", "c_acctbal", "c_nationkey")):
        r = stats.correlate_pair(_t(spark, sf, table), x, y, "kendall")
        found.append((name, r["n"], round(r["r"], 9), round(r["p_value"], 6)))
    return spark.createDataFrame(found, "pair string, n bigint, tau double, p_value double")


# Newton steps for one covariate of 0 and 1, from counts by time; l runs over the tied deaths of a time.
_COX_AT = f"""(SELECT d, d1, g, list_sum([exp(b) * (n1 - l / d * d1) / (n0 - l / d * (d - d1) + exp(b) * (n1 - l / d * d1)) FOR l IN range(CAST(d AS BIGINT))]) AS e1,
list_sum([pow(exp(b) * (n1 - l / d * d1) / (n0 - l / d * (d - d1) + exp(b) * (n1 - l / d * d1)), 2) FOR l IN range(CAST(d AS BIGINT))]) AS e2 FROM risk, {{}} WHERE d > 0)"""
_COX = f"""WITH times AS (SELECT t, CAST(sum(e) AS DOUBLE) AS d, CAST(sum(CASE WHEN g = 'a' THEN e ELSE 0 END) AS DOUBLE) AS d1, count(*) FILTER (g = 'a') AS c1, count(*) FILTER (g <> 'a') AS c0 FROM ({_SURV}) GROUP BY t),
risk AS (SELECT t, d, d1, CAST(sum(c1) OVER w AS DOUBLE) AS n1, CAST(sum(c0) OVER w AS DOUBLE) AS n0, sum(d) OVER (ORDER BY t) - d + (d + 1) / 2 AS g FROM times WINDOW w AS (ORDER BY t DESC)),
b0 AS (SELECT 0.0::DOUBLE AS b), {", ".join(f"b{k + 1} AS (SELECT any_value(b) + sum(d1 - e1) / sum(e1 - e2) AS b FROM {_COX_AT.format(f'b{k}')}, b{k})" for k in range(8))},
fit AS (SELECT any_value(b) AS b, 1 / sum(e1 - e2) AS v, sum(d) AS deaths, sum(d * g) / sum(d) AS mid, sum(g * (d1 - e1)) - sum(d * g) / sum(d) * sum(d1 - e1) AS gr, sum(d * g * g) - pow(sum(d * g), 2) / sum(d) AS spread FROM {_COX_AT.format('b8')}, b8),
cells AS (SELECT t, e, CASE WHEN g = 'a' THEN 1 ELSE 0 END AS x, CAST(count(*) AS DOUBLE) AS c FROM ({_SURV}) GROUP BY ALL),
pairs AS (SELECT sum(i.c * j.c * CASE WHEN b * i.x > b * j.x THEN 1 WHEN i.x = j.x THEN 0.5 ELSE 0 END) / sum(i.c * j.c) AS concordance FROM cells i, cells j, fit WHERE i.e = 1 AND (j.t > i.t OR (j.t = i.t AND j.e = 0)))
SELECT 'x' AS covariate, round(b, 6) AS coef, round(exp(b), 6) AS hazard_ratio, round(sqrt(v), 6) AS se, round(concordance, 9) AS concordance, round(deaths * v * gr * gr / spread, 5) AS ph_statistic FROM fit, pairs"""


@query(_COX)
def cox_hazard(spark, sf):
    r = stats.cox_regression(_survival(spark, sf).withColumn("x", (F.col("g") == "a").cast("int")), "t", "e", ["x"])
    c = r["coefficients"]["x"]
    return spark.createDataFrame([("x", *[round(c[k], 6) for k in ("coef", "hazard_ratio", "se")], round(r["concordance"], 9), round(r["ph_test"][0]["test_statistic"], 5))], "covariate string, coef double, hazard_ratio double, se double, concordance double, ph_statistic double")


@query("""WITH c AS (SELECT l_extendedprice AS threshold, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT threshold, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, row_number() OVER w AS place FROM c WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, place, round(tp / (SELECT CAST(sum(p) AS DOUBLE) FROM c), 9) AS tpr, round(fp / (SELECT CAST(sum(n - p) AS DOUBLE) FROM c), 9) AS fpr FROM r""")
def roc_curve(spark, sf):
    """Every point of a curve with nearly as many scores as rows."""
    rows = _t(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.roc_table(rows, "l_extendedprice", "y").select("threshold", "tp", "fp", "place", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


# Neighbours


@query("""WITH s AS (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS b, 100000 * CAST(s_nationkey AS BIGINT) AS n FROM supplier), c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS b, 100000 * CAST(c_nationkey AS BIGINT) AS n FROM customer),
d AS (SELECT s_suppkey, c_custkey, (s.b - c.b) * (s.b - c.b) + (s.n - c.n) * (s.n - c.n) AS d2 FROM s, c)
SELECT s_suppkey, c_custkey, CAST(place AS INTEGER) AS place, CAST(d2 AS BIGINT) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, c_custkey) AS place FROM d) WHERE place <= 5""")
def nearest_customers(spark, sf):
    """The five customers nearest to each supplier by balance, in cents, and nation. The SQL compares all of them."""
    points = lambda table, key, p: _t(spark, sf, table).select(key, F.round(F.col(f"{p}_acctbal") * 100).alias("b"), (100_000.0 * F.col(f"{p}_nationkey")).alias("n"))
    tree = neighbours.box_tree(points("customer", "c_custkey", "c"), "c_custkey", ["b", "n"], 5)
    found = neighbours.nearest(tree, points("supplier", "s_suppkey", "s"), "s_suppkey", ["b", "n"])
    return found.select(F.col("q").alias("s_suppkey"), F.col("r").alias("c_custkey"), "place", F.col("d2").cast("bigint").alias("d2"))


# Clinical rules and the guide's remaining queries


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS start, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def medication_history(spark, sf):
    o = _t(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"), "o_totalprice").orderBy("o_custkey", "start", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity > 45 AND l_tax IS NOT NULL")
def test_detail(spark, sf):
    i = _t(spark, sf, "lineitem").filter("l_quantity > 45 and l_tax is not null")
    return i.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_tax")


_LEVELS = (0, 2999, 3000, 4999, 5000, 20000, 44999, 45000, 60000)
_RUN = "CASE {} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(_LEVELS)) + " END"
_RUNS = f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 155 WHEN 1 THEN 237 ELSE 999 END AS project, {_RUN.format('p_partkey % 10')} AS a, {_RUN.format('p_partkey // 10 % 10')} AS b, {_RUN.format('p_partkey // 100 % 9')} AS c FROM part"
_OVER = lambda low, high=None: " + ".join(f"CAST({c} >= {low}" + (f" AND {c} < {high}" if high else "") + " AS INT)" for c in "abc")


@query(f"""WITH r AS (SELECT *, {_OVER(5000)} AS n5, {_OVER(45000)} AS high, {_OVER(3000, 45000)} AS middle, {_OVER(0, 3000)} AS low, {_OVER(3000)} AS raised FROM ({_RUNS})),
s AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL
  WHEN project = 155 THEN CASE WHEN n5 = 3 THEN 'Positive' WHEN n5 IN (0, 1) THEN 'Negative' WHEN n5 = 2 THEN 'Inconclusive' END
  WHEN project = 237 THEN CASE WHEN high = 3 OR middle IN (2, 3) OR (high = 2 AND middle = 1) THEN 'Positive' WHEN raised IN (0, 1) THEN 'Negative' WHEN (high = 2 AND low = 1) OR (high = 1 AND middle = 1 AND low = 1) THEN 'Inconclusive' END END AS status FROM r)
SELECT p_partkey, status, CASE WHEN project = 237 THEN CASE WHEN status = 'Positive' AND high = 3 THEN 'Type 1' WHEN status = 'Positive' AND high = 2 THEN 'Undetermined' WHEN status = 'Positive' AND middle + low >= 2 THEN 'Type 2' WHEN status = 'Negative' THEN 'NA' END END AS assay_type FROM s""")
def assay_status(spark, sf):
    """Every combination of values around the bounds, under both projects and an unknown one. The SQL follows the published decision tables line by line."""
    k = F.col("p_partkey")
    level = lambda i: F.get(F.array(*map(F.lit, _LEVELS)), i.cast("int"))
    runs = _t(spark, sf, "part").select("p_partkey", F.when(k % 3 == 0, 155).when(k % 3 == 1, 237).otherwise(999).alias("project"), level(k % 10).alias("a"), level(F.floor(k / 10) % 10).alias("b"), level(F.floor(k / 100) % 9).alias("c"))
    return clinical.assay_status(runs, ["a", "b", "c"], "project").select("p_partkey", "status", "assay_type")


_CLINIC = """SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN CASE user_id % 5 WHEN 3 THEN 0 WHEN 4 THEN event_id // 5 % 4 ELSE 1 END END AS s, CASE WHEN event_id % 7 < 2 THEN CASE WHEN user_id % 4 = 0 THEN 0 ELSE event_id // 7 % 2 END END AS d,
CASE WHEN user_id % 6 = 3 THEN 3 ELSE user_id % 3 END AS g, CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id * 7 % 5 END END AS item, CASE WHEN event_id % 4 <> 0 THEN 18 + event_id * 13 % 13 END AS moca,
CASE WHEN event_id % 8 < 5 THEN 0 ELSE event_id * 17 % 9 END AS signs, CASE WHEN event_id % 9 <> 0 THEN CASE WHEN event_id % 10 < 6 THEN event_id % 14 ELSE event_id * 31 % 50 END END AS motor,
CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 10 < 6 THEN event_id % 13 ELSE event_id * 29 % 45 END END AS rest, CAST(event_id % 13 = 0 AS INT) AS med, CAST(event_id % 17 = 0 AS INT) AS rbd, CASE WHEN event_id % 10 < 7 THEN 50 ELSE event_id * 37 % 100 END AS smell FROM events"""
_CARRIED = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("s", "d", "g", "item", "moca", "signs", "motor", "rest", "med", "rbd", "smell"))


@query(f"""WITH v AS (SELECT event_id, {_CARRIED} FROM ({_CLINIC})),
y AS (SELECT *, (signs >= 5 OR med = 1) AS park, (item >= 1 OR signs >= 5 OR med = 1 OR rbd = 1 OR smell <= 15) AS sym FROM v),
f AS (SELECT *, CASE WHEN item = 4 AND moca <= 24 THEN 6 WHEN (item = 3 AND moca <= 24) OR (item = 4 AND moca >= 25) THEN 5 WHEN (item = 2 AND moca <= 24) OR (item = 3 AND moca >= 25) THEN 4 WHEN (item = 1 AND moca <= 24) OR (item = 2 AND moca >= 25) THEN 3 WHEN item = 0 OR (item = 1 AND moca >= 25) THEN 0 END AS cog,
  CASE WHEN motor >= 40 THEN 6 WHEN motor BETWEEN 27 AND 39 THEN 5 WHEN motor BETWEEN 14 AND 26 THEN 4 WHEN motor BETWEEN 3 AND 13 AND park THEN 3 WHEN motor BETWEEN 0 AND 13 THEN 0 END AS mot,
  CASE WHEN rest >= 37 THEN 6 WHEN rest BETWEEN 25 AND 36 THEN 5 WHEN rest BETWEEN 13 AND 24 AND sym THEN 4 WHEN rest BETWEEN 13 AND 24 AND sym IS NULL THEN NULL WHEN rest >= 0 THEN 0 END AS oth FROM y),
w AS (SELECT *, greatest(cog, mot, oth) AS worst, cog IS NULL OR mot IS NULL OR oth IS NULL AS gap FROM f)
SELECT event_id, CASE WHEN s = 1 OR g = 3 THEN 1 WHEN s <> 1 THEN 0 END AS nsd,
CASE WHEN s = 1 AND d = 1 AND (worst = 6 OR (NOT gap AND worst >= 3)) THEN CAST(worst AS VARCHAR) WHEN s = 1 AND d = 1 AND gap THEN NULL WHEN s = 1 AND d = 1 AND sym THEN '2B' WHEN s = 1 AND d = 1 AND NOT sym THEN '1B'
WHEN s = 1 AND d = 0 AND sym THEN '2A' WHEN s = 1 AND d = 0 AND NOT sym THEN '1A' WHEN s <> 1 AND d = 0 AND g = 3 THEN '0' END AS stage FROM w""")
def synuclein_stage(spark, sf):
    """Stages of visits with gaps that earlier visits fill. The SQL states the published anchors stage by stage."""
    e, u = F.col("event_id"), F.col("user_id")
    nth = lambda n: F.floor(e / n)
    visits = _t(spark, sf, "events").select(
        "event_id", "user_id", F.when(e % 5 == 0, F.when(u % 5 == 3, 0).when(u % 5 == 4, nth(5) % 4).otherwise(1)).alias("s"), F.when(e % 7 < 2, F.when(u % 4 == 0, 0).otherwise(nth(7) % 2)).alias("d"), F.when(u % 6 == 3, 3).otherwise(u % 3).alias("g"),
        F.when(e % 3 != 0, F.when(e % 2 == 0, 0).otherwise(e * 7 % 5)).alias("cognition"), F.when(e % 4 != 0, 18 + e * 13 % 13).alias("moca"), F.when(e % 8 < 5, 0).otherwise(e * 17 % 9).alias("signs"),
        F.when(e % 9 != 0, F.when(e % 10 < 6, e % 14).otherwise(e * 31 % 50)).alias("motor"), F.when(e % 11 != 0, F.when(e % 10 < 6, e % 13).otherwise(e * 29 % 45)).alias("non_motor"), (e % 13 == 0).cast("int").alias("medicated"), (e % 17 == 0).cast("int").alias("rbd"), F.when(e % 10 < 7, 50).otherwise(e * 37 % 100).alias("smell"))
    return clinical.synuclein_stage(visits, "user_id", "event_id", {f: f for f in clinical.STAGE_FIELDS}).select("event_id", "nsd", "stage")


@query("SELECT p_partkey, a, b, c, greatest(a, b, c) AS stage FROM (SELECT p_partkey, CAST(p_size % 4 AS INT) AS a, CAST(p_partkey % 5 AS INT) AS b, CASE WHEN p_partkey % 3 = 0 THEN 6 END AS c FROM part)")
def worst_stage(spark, sf):
    k = F.col("p_partkey")
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).cast("int").alias("a"), (k % 5).cast("int").alias("b"), F.when(k % 3 == 0, 6).alias("c"))
    return clinical.worst_stage(p, ["a", "b", "c"])


@query("SELECT user_id, project, run, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY project = 237 DESC NULLS LAST, run DESC) AS r FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 237 ELSE 155 END AS project, ts AS run, event_id FROM events)) WHERE r = 1")
def preferred_run(spark, sf):
    e = _t(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, 237).otherwise(155).alias("project"), F.col("ts").alias("run"), "event_id")
    return clinical.preferred_run(e, "user_id", "project", 237, "run")


_MEDS = "SELECT o_custkey AS subject, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 - 5 AS INTEGER) END AS e, o_orderkey % 4 AS kind, o_orderkey % 200 AS dose FROM orders"


@query(f"""WITH x AS ({_MEDS}), t AS (SELECT subject, s AS t FROM x UNION SELECT subject, CAST(e + INTERVAL 1 MONTH AS DATE) FROM x WHERE e IS NOT NULL),
v AS (SELECT t.subject, t.t, coalesce(sum(CASE WHEN kind = 0 THEN dose END), 0) AS l, coalesce(sum(CASE WHEN kind = 1 THEN dose END), 0) AS b, CAST(count(CASE WHEN kind = 2 THEN 1 END) AS DOUBLE) AS m,
  CAST(count(CASE WHEN kind = 3 THEN 1 END) AS DOUBLE) AS n, coalesce(sum(CASE WHEN kind = 3 THEN dose END), 0) AS added
  FROM t LEFT JOIN x ON x.subject = t.subject AND x.s <= t.t AND (x.e IS NULL OR x.e >= t.t) AND (x.e IS NULL OR x.e >= x.s) GROUP BY 1, 2)
SELECT subject, t, round(CAST(l AS DOUBLE), 4) AS levodopa, round(b + l + 0.33 * m * l + 0.5 * (added + n * l), 4) AS total FROM v""")
def ledd_at_dates(spark, sf):
    """By quarters of the prescriptions: levodopa, a fixed dose, a factor of the levodopa in force, a dose and the levodopa under a factor.
    Some stop before they start and count at no date."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    text = F.when(k % 4 == 2, "LD x 0.33").when(k % 4 == 3, F.concat(F.lit("("), (k % 200).cast("string"), F.lit(" + LD) x 0.5"))).otherwise((k % 200).cast("string"))
    meds = _t(spark, sf, "orders").select(F.col("o_custkey").alias("PATNO"), F.when(k % 4 == 0, "SINEMET").otherwise("other").alias("LEDTRT"), start.alias("STARTDT"), F.when(k % 4 != 0, F.date_add(start, (k % 50 - 5).cast("int"))).alias("STOPDT"), text.alias("LEDD"))
    out = clinical.total_ledd_at(meds)
    return out.select("subject", "t", (F.round("levodopa", 4) + F.lit(0.0)).alias("levodopa"), (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("SELECT y AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM (SELECT o_orderstatus AS y FROM orders) GROUP BY y")
def class_counts(spark, sf):
    c = _t(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).first()[0]
    return c.select("label", "n", F.round(F.col("n") / F.lit(total), 9).alias("share"))


# Sources


@query("SELECT CAST(user_id AS VARCHAR) AS PATNO, CAST(CAST(ts AS DATE) AS VARCHAR) AS EVENT_ID, event_type, event_id AS ordinal, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events")
def csv_round_trip(spark, sf):
    """A table written as CSV and read again with its types inferred."""
    from ..session import scratch_path

    v = _visits(spark, sf)
    path = scratch_path(spark, "csv")
    io.write_csv(v, path, single=False)
    back = io.read_csv(spark, path)
    return back.select(F.col("PATNO").cast("string").alias("PATNO"), F.col("EVENT_ID").cast("string").alias("EVENT_ID"), "event_type", F.col("ordinal").cast("bigint").alias("ordinal"), "value")


_ASKED = "CASE c_custkey % 4 WHEN 0 THEN ' Motor_Assessments; biospecimen ' || c_mktsegment WHEN 1 THEN c_mktsegment WHEN 2 THEN 'medical_history,,MEDICAL_HISTORY' END"
_ALL = "'subject_characteristics,medical_history,motor_assessments,non_motor_assessments,biospecimen'"


@query(f"""SELECT c_custkey, CASE WHEN asked LIKE ' Motor%' THEN 'motor_assessments,biospecimen' WHEN asked LIKE 'medical%' THEN 'medical_history,medical_history' ELSE {_ALL} END AS modalities FROM (SELECT c_custkey, {_ASKED} AS asked FROM customer)""")
def modality_list(spark, sf):
    """Wishes of each row: names in either case, unknown ones among them; none known, or no wish, means all."""
    c = _t(spark, sf, "customer").select("c_custkey", F.expr(_ASKED).alias("asked"))
    return c.select("c_custkey", F.array_join(io.modalities_of(F.col("asked")), ",").alias("modalities"))


@query("SELECT n_name AS \"column\" FROM nation")
def leakage_list(spark, sf):
    """Names, a line each, come back from the file that holds them."""
    from ..session import scratch_path

    path = scratch_path(spark, "leakage")
    _t(spark, sf, "nation").select("n_name").coalesce(1).write.text(path)
    return spark.createDataFrame([(x,) for x in io.read_leakage(spark, path)], "column string")


@query("SELECT label, prediction, n, round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 9) AS recall_share FROM (SELECT l_returnflag AS label, CASE WHEN l_quantity > 30 THEN 'R' WHEN l_quantity > 12 THEN 'A' ELSE 'N' END AS prediction, count(*) AS n FROM lineitem GROUP BY ALL)")
def confusion_multiclass(spark, sf):
    q = F.col("l_quantity")
    c = ml.confusion(_t(spark, sf, "lineitem").select("l_returnflag", F.when(q > 30, "R").when(q > 12, "A").otherwise("N").alias("p")), "l_returnflag", "p")
    totals = c.groupBy("label").agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(totals), "label").select("label", "prediction", "n", F.round(F.col("n") / F.col("t"), 9).alias("recall_share"))  # a row a class


_STUDY = """WITH a AS (SELECT CAST(p_partkey AS VARCHAR) AS PATNO, p_brand AS EVENT_ID, CASE WHEN p_size % 4 = 2 THEN 0.5 ELSE CAST(p_size % 4 AS DOUBLE) END AS feat FROM part),
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS PATNO, 'Brand#' || CAST(11 + s_nationkey % 3 AS VARCHAR) AS EVENT_ID, s_nationkey AS score FROM supplier)"""


@query(f"{_STUDY} SELECT coalesce(a.PATNO, b.PATNO) AS PATNO, coalesce(a.EVENT_ID, b.EVENT_ID) AS EVENT_ID, feat AS medical_history_features_of_parkinsonism_FEATBRADY, CAST(score AS BIGINT) AS motor_assessments_updrs_SCORE FROM a FULL JOIN b ON a.PATNO = b.PATNO AND a.EVENT_ID = b.EVENT_ID")
def study_load_merged(spark, sf):
    """A study of two files in folders by modality is loaded, cleaned (2 is uncertain) and merged."""
    from ..session import scratch_path
    from ..sources import study

    path = scratch_path(spark, "study")
    part = _t(spark, sf, "part").select(F.col("p_partkey").alias("PATNO"), F.col("p_brand").alias("EVENT_ID"), (F.col("p_size") % 4).alias("FEATBRADY"))
    supplier = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("PATNO"), F.concat(F.lit("Brand#"), (11 + F.col("s_nationkey") % 3).cast("string")).alias("EVENT_ID"), F.col("s_nationkey").alias("SCORE"))
    io.write_csv(part, f"{path}/Medical_History/features_of_parkinsonism.csv")
    io.write_csv(supplier, f"{path}/Motor___MDS-UPDRS/updrs.csv")
    wide = study.load(spark, path, merge_output=True)
    score = F.col("motor_assessments_updrs_SCORE").cast("bigint").alias("motor_assessments_updrs_SCORE")
    return wide.select("PATNO", "EVENT_ID", "medical_history_features_of_parkinsonism_FEATBRADY", score)


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice END AS late, o_orderkey % 5 = 0 AS test FROM orders)
SELECT o_orderkey, test, round(coalesce(price, (SELECT avg(price) FROM a WHERE NOT test)), 4) AS price FROM a""")
def impute_from_train(spark, sf):
    """Gaps of training and test rows are filled with the training mean; a column that holds nothing in training leaves."""
    o, k = _t(spark, sf, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", (k % 5 == 0).alias("test"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 == 0, F.col("o_totalprice")).alias("late"))
    train, test = features.TrainImputer("mean").fit_transform(rows.filter("not test"), rows.filter("test"), ["price", "late"])
    return train.unionByName(test).withColumn("price", F.round("price", 4))


_SIZE = 500


@query(f"""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1),
q AS (SELECT s, CAST(floor({_SIZE} * n / CAST(t AS DOUBLE)) AS BIGINT) AS own, CAST(({_SIZE} * n) % t AS BIGINT) AS r, t FROM c),
l AS (SELECT s, own + CASE WHEN row_number() OVER (ORDER BY r DESC, s) <= {_SIZE} - sum(own) OVER () THEN 1 ELSE 0 END AS most, t FROM q)
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS p FROM orders) o JOIN l ON s = o_orderstatus WHERE p <= most OR t <= {_SIZE}""")
def stratified_sample(spark, sf):
    """A sampling operator: at most 500 orders, the states in their shares."""
    return ml.stratified_sample(_t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", _SIZE, "o_orderkey")


@query("""WITH a AS (SELECT l_linenumber AS x, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem), m AS (SELECT avg(y) AS p FROM a),
b AS (SELECT x, count(*) AS n, sum(y) AS s FROM a GROUP BY x)
SELECT CAST(x AS BIGINT) AS line, round(1 / (1 + exp(-(ln(p / (1 - p)) + (s - n * p) / (n * p * (1 - p) + 1)))), 6) AS chance FROM b, m""")
def boosted_bins(spark, sf):
    """Explainable boosting of one feature, one full step with as many ranges as values: a Newton step a value."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from ..operators.additive import AdditiveBoost

    rows = _t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("double").alias("x"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    scored = AdditiveBoost(cycles=1, rate=1.0, leaves=100).fit(rows).transform(rows.select("x", "features").distinct())
    return scored.select(F.col("x").cast("bigint").alias("line"), F.round(vector_to_array("probability")[1], 6).alias("chance"))


# P-values beside the statistics of earlier rows

_PAIRED = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, CAST(count(*) AS DOUBLE) AS n FROM lineitem" for k, a in enumerate(_FEATURES) for b in _FEATURES[k + 1 :])


@query(f"""WITH c AS (SELECT x, y, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({_PAIRED})), p AS (SELECT x, y, {_t_two_sided('t', 'df', 400_000)} AS p FROM c),
o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM p)
SELECT x, y, round(p, 4) AS p_value, round(least(1.0, min(p * m / i) OVER (ORDER BY i DESC)), 4) AS p_adjusted FROM o""")
def corr_matrix_p(spark, sf):
    """The p-value of each correlation, and adjusted for all of them."""
    m = stats.correlation_matrix(_t(spark, sf, "lineitem"), list(_FEATURES))
    return _frame(spark, [{"x": a, "y": b, "p_value": round(p, 4), "p_adjusted": round(m["p_adjusted"][a, b], 4)} for (a, b), p in m["p"].items()])


_NESTED = """r AS (SELECT l_linenumber % 2 AS g, l_tax AS x, l_discount AS y FROM lineitem), w AS (SELECT g, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r GROUP BY g),
p AS (SELECT sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy, CAST(sum(n) - 3 AS DOUBLE) AS df FROM w), a AS (SELECT regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss FROM r),
f AS (SELECT 'g' AS term, df, (a.rss - (syy - sxy * sxy / sxx)) / ((syy - sxy * sxy / sxx) / df) AS f FROM a, p UNION ALL SELECT 'x', df, sxy * sxy / sxx / ((syy - sxy * sxy / sxx) / df) FROM p)"""


@query(f"WITH {_NESTED} SELECT term, round(f, 4) AS f, round({_t_two_sided('sqrt(greatest(f, 0.0))', 'df')}, 4) AS p_value FROM f")
def ancova_p(spark, sf):
    """Two groups and one covariate: each F has one degree of freedom and is the square of a t."""
    i = _t(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("g"), F.col("l_tax").alias("x"), F.col("l_discount").alias("y"))
    return _frame(spark, [{"term": r["term"], "f": round(r["F"], 4), "p_value": round(r["p_value"], 4)} for r in stats.ancova(i, "y", "g", ["x"]) if r["F"] is not None])


@query("""WITH c AS (SELECT unnest([count_if(p_size % 5 = 0), count_if(p_size % 7 = 0), count_if(p_size % 6 = 0)]) AS n FROM part), m AS (SELECT avg(n) AS m FROM c)
SELECT round(sum((n - m) * (n - m) / m), 6) AS chi2, CAST(2 AS DOUBLE) AS dof, round(exp(-sum((n - m) * (n - m) / m) / 2), 6) AS p_value FROM c, m""")
def missingness_test(spark, sf):
    """Whether three columns miss equally often: with two degrees of freedom p is exp(-chi2 / 2)."""
    n = F.col("p_size")
    r = stats.missingness_report(_t(spark, sf, "part").select(*[F.when(n % k != 0, 1).alias(f"c{k}") for k in (5, 7, 6)]))
    return _frame(spark, [{k: r[k] for k in ("chi2", "dof", "p_value")}])


@query("""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS qe, abs(corr(l_quantity, twice)) AS qt, abs(corr(l_extendedprice, twice)) AS et, abs(corr(l_quantity, l_tax)) AS qx, abs(corr(l_extendedprice, l_tax)) AS ex, abs(corr(twice, l_tax)) AS tx
FROM (SELECT *, 2 * l_quantity + l_tax AS twice FROM lineitem)), k AS (SELECT *, qe <= 0.8 AS e FROM c), t AS (SELECT *, qt <= 0.8 AND (NOT e OR et <= 0.8) AS t FROM k)
SELECT unnest(list_filter(['l_quantity', CASE WHEN e THEN 'l_extendedprice' END, CASE WHEN t THEN 'twice' END, CASE WHEN qx <= 0.8 AND (NOT e OR ex <= 0.8) AND (NOT t OR tx <= 0.8) THEN 'l_tax' END], lambda x: x IS NOT NULL)) AS feature FROM t""")
def select_uncorrelated(spark, sf):
    """Of columns that correlate beyond 0.8 the first stays."""
    i = _t(spark, sf, "lineitem").withColumn("twice", 2 * F.col("l_quantity") + F.col("l_tax")).withColumn("y", F.col("l_returnflag"))
    kept = select.FeatureSelector("correlation", threshold=0.8).fit(i, ["l_quantity", "l_extendedprice", "twice", "l_tax"], "y").selected
    return spark.createDataFrame([(c,) for c in kept], "feature string")
