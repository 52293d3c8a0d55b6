"""Scalar expressions and ordering helpers."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settled

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
GUARD_WORDS = ("ID", "DATE", "TIME", "PATNO", "EVENT")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    return [c for c, t in df.dtypes if is_numeric(t) and c not in skip]


def string_columns(df: DataFrame, skip=()) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c not in skip]


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """One kind of missing value: NaN becomes NULL."""
    fixed = {c: F.when(~F.isnan(quoted(c)), quoted(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixed) if fixed else df


def pipe_average(c: Column) -> Column:
    """Mean of a|b|c; any part that is no number gives NULL; other values pass through as numbers."""
    parts = F.transform(F.split(c, r"\|"), lambda x: F.trim(x).try_cast("double"))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return F.when(c.contains("|"), mean).otherwise(F.trim(c).try_cast("double"))


def pipe_first(c: Column) -> Column:
    return F.split(c, r"\|")[0]


def pipe_count(c: Column) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), 0).otherwise(F.size(F.split(c, r"\|")))


def pipe_tokens(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def has_pipe(c: Column) -> Column:
    return F.coalesce(c.contains("|"), F.lit(False))


def guarded(name: str) -> bool:
    """Identifier and date columns that coercion leaves alone."""
    return any(w in name.upper() for w in GUARD_WORDS)


def coerce_numeric_majority(df: DataFrame, share: float = 0.9) -> DataFrame:
    """String columns of which more than ``share`` of the non-null values read as numbers become numbers: one pass decides."""
    names = [c for c in string_columns(df) if not guarded(c)]
    if not names:
        return df
    ratios = df.agg(*[(F.count(pipe_average(quoted(c))) / F.expr(f"nullif(count(`{c}`), 0)")).alias(c) for c in names]).first()
    return df.withColumns({c: pipe_average(quoted(c)) for c in names if (ratios[c] or 0) > share})


def log_offset(c: Column, offset: float = 0.0) -> Column:
    x = c.cast("double") + offset
    return F.when(x > 0, F.ln(x))


def sqrt_offset(c: Column, offset: float = 0.0) -> Column:
    x = c.cast("double") + offset
    return F.when(x >= 0, F.sqrt(x))


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def month_date(c: Column) -> Column:
    """MM/YYYY as the first of the month; anything else NULL."""
    return F.to_date(F.try_to_timestamp(c, F.lit("MM/yyyy")))


def range_bucket(df: DataFrame, column: str, n: int = 64) -> Column:
    """A bucket number that grows with ``column``: at most ``n`` bounds are collected."""
    bounds = sorted(set(df.select(F.percentile_approx(quoted(column), [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    if not bounds:
        return F.lit(0)
    return F.aggregate(F.array(*[F.lit(x) for x in bounds]), F.lit(0), lambda k, x: k + F.when(quoted(column) >= x, 1).otherwise(0))


#: Distinct values a bucket should hold about, and the most buckets of a group.
BUCKET_VALUES = 50_000
MAX_BUCKETS = 1024
_HALVES = [1 << k for k in reversed(range(MAX_BUCKETS.bit_length() - 1))]


def with_buckets(df: DataFrame, column: str, by: list[str] | None = None, per_bucket: int = BUCKET_VALUES) -> DataFrame:
    """``df`` with ``_b``, a bucket number that grows with ``column`` within each group of ``by``.

    A group gets bounds of its own, as many as its rows call for: quantiles of one sketch a group, found in one aggregate and written
    down. That table has a row a group, and bounds only for groups of more than ``per_bucket`` rows; it is broadcast if the groups
    are few. Rows are placed by halving the bounds.
    """
    by = by or []
    shares = ", ".join(f"{k / MAX_BUCKETS}D" for k in range(1, MAX_BUCKETS))
    name = column.replace("`", "``")
    found = df.groupBy(*by).agg(F.count(quoted(column)).alias("_d"), F.expr(f"percentile_approx(`{name}`, array({shares}), {10 * MAX_BUCKETS})").alias("_p"))  # one text: a call a share would be slow
    wanted = F.least(F.ceil(F.col("_d") / per_bucket), F.lit(MAX_BUCKETS)).cast("int")
    bounds = F.when(wanted > 1, F.transform(F.sequence(F.lit(1), F.greatest(wanted, F.lit(2)) - 1), lambda k: F.col("_p")[(k * MAX_BUCKETS / wanted).cast("int") - 1])).otherwise(F.array().cast(f"array<{dict(df.dtypes)[column]}>"))
    sizes = broadcast_if_small(settled(found.select(*by, bounds.alias("_bounds")), "bounds"))
    joined = df.join(sizes, by) if by else df.crossJoin(sizes)  # without groups: one row
    v = quoted(column)
    place = F.aggregate(F.array(*map(F.lit, _HALVES)), F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) <= v, at + step).otherwise(at))
    return joined.withColumn("_b", F.when(F.size("_bounds") == 0, 0).otherwise(place)).drop("_bounds")


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of that column over the rows of the group up to the row's ``order``, itself included.

    Rows of a group are summed in range buckets and the buckets' sums in order, so no task holds a group. Orders that have no quantiles
    (texts, structs) are put into ranges of the whole table instead. Rows of one group and equal ``order`` count one after another, in no
    fixed sequence; groups of a null key are left out.
    """
    by = by or []
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    kind = dict(df.dtypes)[order]
    if is_numeric(kind) or kind in ("date", "timestamp", "timestamp_ntz"):
        bucketed = with_buckets(df, order, by)
    else:
        bucketed = settled(df.repartitionByRange(*[quoted(c) for c in by], quoted(order)).withColumn("_b", F.spark_partition_id()), "ranges")
    totals = bucketed.groupBy(*by, "_b").agg(*[F.sum(quoted(c)).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    before = Window.partitionBy(*by).orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_s{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(sums))])
    inside = Window.partitionBy(*by, "_b").orderBy(quoted(order).desc() if descending else quoted(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bucketed.join(offsets, [*by, "_b"])
    return out.select(*[quoted(c) for c in df.columns], *[(F.col(f"_o{k}") + F.sum(quoted(c)).over(inside)).alias(name) for k, (name, c) in enumerate(sums.items())])


def average_ranks(df: DataFrame, column: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``df``'s (by, column) values with their mid-ranks and tie counts: (by, column, ties, rank). Values are counted first.

    weight: a column of counts, where a row stands for several.
    """
    by = by or []
    values = df.filter(quoted(column).isNotNull()).groupBy(*by, column).agg((F.sum(quoted(weight)) if weight else F.count("*")).alias("ties"))
    ranked = running_sums(values, column, {"_upto": "ties"}, by)
    return ranked.select(*by, column, "ties", (F.col("_upto") - (F.col("ties") - 1) / 2).alias("rank"))


#: Share of a group's rows on either side of a wanted rank whose values are counted; the sketch errs by a twentieth of it at most.
_WINDOW = 0.002
_SKETCH = 10_000
_SMALL = 2000


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column for each of ``shares``): linearly interpolated quantiles of the non-null values, exact.

    One aggregate of sketches a group gives bounds around each wanted rank; then only the values between these bounds, a small part of
    the rows, are counted and ranked, in range buckets, and those below the bounds are counted. Groups of at most 2000 rows
    are counted whole. A wanted rank outside its bounds is an error, not a wrong answer.
    """
    by = by or []
    names = list(shares)
    rows = df.filter(quoted(column).isNotNull()).select(*[quoted(c) for c in by], quoted(column).alias("_v"))
    edges = [min(1.0, max(0.0, shares[n] + side)) for n in names for side in (-_WINDOW, _WINDOW)]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", edges, _SKETCH).alias("_p"))
    small = F.col("_n") <= _SMALL
    low = lambda k: F.when(small | F.lit(edges[2 * k] == 0), F.col("_min")).otherwise(F.col("_p")[2 * k])
    high = lambda k: F.when(small | F.lit(edges[2 * k + 1] == 1), F.col("_max")).otherwise(F.col("_p")[2 * k + 1])
    edged = [c for k in range(len(names)) for c in (low(k).alias(f"_l{k}"), high(k).alias(f"_h{k}"))]
    bounds = broadcast_if_small(settled(sketch.select(*by, "_n", *edged), "quantile-bounds"))
    met = rows.join(bounds, by) if by else rows.crossJoin(bounds)  # without groups: one row
    below = met.groupBy(*by).agg(F.max("_n").alias("_n"), *[F.count_if(F.col("_v") < F.col(f"_l{k}")).alias(f"_u{k}") for k in range(len(names))])
    within = [F.col("_v").between(F.col(f"_l{k}"), F.col(f"_h{k}")) for k in range(len(names))]
    near = met.filter(functools.reduce(lambda a, b: a | b, within)).select(*by, "_v", F.explode(F.array_compact(F.array(*[F.when(w, k) for k, w in enumerate(within)]))).alias("_k"))
    cells = settled(near.groupBy(*by, "_k", "_v").agg(F.count("*").alias("_c")), "quantile-values")
    below = settled(below, "quantile-counts")
    below = below.select(*by, "_n", F.posexplode(F.array(*[F.col(f"_u{k}") for k in range(len(names))])).alias("_k", "_u"))
    ranks = average_ranks(cells, "_v", [*by, "_k"], "_c").join(below, [*by, "_k"])
    ranks = ranks.withColumn("_first", F.col("rank") - (F.col("ties") - 1) / 2 - 1 + F.col("_u"))
    picks = []
    for k, share in enumerate(shares.values()):
        at = (F.col("_n") - 1) * share
        value = lambda p: F.max(F.when((F.col("_k") == k) & (F.col("_first") <= p) & (p < F.col("_first") + F.col("ties")), F.col("_v")))  # noqa: E731, B023
        picks += [value(F.floor(at)).alias(f"_a{k}"), value(F.least(F.floor(at) + 1, F.col("_n") - 1)).alias(f"_b{k}"), F.max(at - F.floor(at)).alias(f"_s{k}")]
    out = ranks.groupBy(*by).agg(*picks)
    sure = lambda c: F.coalesce(c, F.raise_error(F.lit("a wanted rank is outside its sketch's bounds")).cast("double"))
    return out.select(*by, *[F.when(F.col(f"_s{k}").isNotNull(), sure(F.col(f"_a{k}")) * (1 - F.col(f"_s{k}")) + sure(F.col(f"_b{k}")) * F.col(f"_s{k}")).alias(name) for k, name in enumerate(names)])


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column, in one long form."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("v")) for c in columns])
    found = exact_quantiles(df.select(F.explode(cells).alias("x")).select("x.*"), "v", {"m": 0.5}, ["column"])
    held = {r.column: r.m for r in found.collect()}
    return {c: held.get(c) for c in columns}
