"""Feature engineering: a chain of lazy transforms."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import column_medians, log_offset, numeric_columns, pipe_count, pipe_first, pipe_tokens, quoted, running_sums, safe_divide, sqrt_offset, string_columns
from ..model import ENCODING_IGNORED, KEYS, OTHER_BUCKET, TARGET
from ..session import settled
from . import neighbours
from .reduce import _long

SKIP = (*KEYS, TARGET)


def one_hot(df: DataFrame, columns: list[str] | None = None, sep: str = "_", dummy_na: bool = False, drop_first: bool = False, max_categories: int = 20, min_frequency: float | None = None, ignore: list[str] | None = None, auto_threshold: int = 50) -> DataFrame:
    """0/1 columns of categories, sorted; rare ones (share below ``min_frequency``) are one bucket unless all are rare."""
    skip = {x.upper() for x in ENCODING_IGNORED} | {x.upper() for x in ignore or []}
    names = [c for c in (columns or string_columns(df)) if c in df.columns and c.upper() not in skip]
    if not names:
        return df
    counts = _long(df, names).groupBy("column", "value").agg(F.count("*").alias("n"))
    # Categories beyond what can be encoded are counted, not collected.
    sizes = {r.column: r.k for r in counts.groupBy("column").agg(F.count("*").alias("k")).collect()}
    limit = auto_threshold if columns is None else math.inf
    use = [c for c in names if sizes.get(c, 0) <= min(limit, max_categories)]
    found: dict[str, dict] = {c: {} for c in use}
    for r in counts.filter(F.col("column").isin(*use)).collect() if use else []:
        found[r.column][r.value] = r.n
    out, gone = [], []
    for c in use:
        total = sum(found[c].values())
        rare = {v for v, n in found[c].items() if min_frequency is not None and n / total < min_frequency}
        if len(rare) == len(found[c]):
            rare = set()
        x = quoted(c).cast("string")
        if rare:
            named = [v for v in rare if v is not None]
            hit = (x.isin(*named) if named else F.lit(False)) | (x.isNull() if None in rare else F.lit(False))
            x = F.when(F.coalesce(hit, F.lit(False)), OTHER_BUCKET).otherwise(x)
        values = sorted({v for v in found[c] if v is not None} - rare | ({OTHER_BUCKET} if rare else set()))
        out += [F.when(x == v, 1).otherwise(0).alias(f"{c}{sep}{v}") for v in (values[1:] if drop_first else values)]
        if dummy_na:
            out.append(x.isNull().cast("int").alias(f"{c}{sep}nan"))
        gone.append(c)
    return df.select(*[quoted(c) for c in df.columns if c not in gone], *out)


def pipe_separated(df: DataFrame, column: str, strategy: str = "first", prefix: str | None = None, max_tokens: int = 30) -> DataFrame:
    if strategy == "first":
        return df.withColumn(column, pipe_first(quoted(column)))
    if strategy == "count":
        return df.withColumn(f"{column}_count", pipe_count(quoted(column)))
    if strategy == "multi_hot":
        tokens = df.select(F.explode(pipe_tokens(quoted(column))).alias("t")).distinct().limit(max_tokens + 1)
        names = sorted(r.t for r in tokens.collect())
        if len(names) > max_tokens:
            return df
        held = F.coalesce(pipe_tokens(quoted(column)), F.expr("cast(array() as array<string>)"))
        flags = [F.array_contains(held, t).cast("int").alias(f"{prefix or column}_{t.replace(' ', '_').replace('-', '_').lower()}") for t in names]
        return df.select(*[quoted(c) for c in df.columns if c != column], *flags)
    return df


def transform_column(df: DataFrame, column: str, func: Callable[[Column], Column], new: str | None = None) -> DataFrame:
    """``func`` maps a Column to a Column, or is a pandas UDF; a failing one leaves the data as it is."""
    try:
        return df.withColumn(new or column, func(quoted(column)))
    except Exception:
        return df


def scale(df: DataFrame, columns: list[str] | None = None, kind: str = "standard") -> DataFrame:
    """Mean 0 and population deviation 1, or 0 to 1; constants have scale 1; all-null columns go."""
    if kind not in ("standard", "minmax"):
        return df
    names = [c for c in (columns or numeric_columns(df, SKIP)) if c in df.columns]
    if not names:
        return df
    v = _long(df, names).select("column", F.col("value").cast("double").alias("v")).groupBy("column")
    stats = {r.column: r for r in v.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    out = []
    for c in df.columns:
        r = stats.get(c)
        if r is None:
            out.append(quoted(c))
        elif r.n:
            shift, width = (r.m, r.s) if kind == "standard" else (r.lo, r.hi - r.lo)
            out.append(((quoted(c).cast("double") - shift) / (width or 1.0)).alias(c))
    return df.select(*out)


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = False) -> DataFrame:
    """Products of median-filled columns, named a^2 and "a b"; existing names stay."""
    names = [c for c in columns if c in df.columns]
    medians = column_medians(df, names)
    x = {c: F.coalesce(quoted(c).cast("double"), F.lit(medians[c])) for c in names}
    pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    out = {"1": F.lit(1.0)} if include_bias else {}
    for d in range(2, degree + 1):
        for combo in pick(names, d):
            parts = [c if (n := combo.count(c)) == 1 else f"{c}^{n}" for c in dict.fromkeys(combo)]
            product = x[combo[0]]
            for c in combo[1:]:
                product = product * x[c]
            out[" ".join(parts)] = product
    return df.withColumns({k: v for k, v in out.items() if k not in df.columns})


def box_cox_lambda(df: DataFrame, column: str, yeo_johnson: bool = False, within: float = 1e-5) -> float | None:
    """The lambda of most likelihood, to ``within``. None where Box-Cox does not apply, or where all values are one.

    A grid is moved and widened until its best point is inside, then narrowed around it: one aggregate a step. Likelihoods that
    overflow do not count.
    """
    x = quoted(column).cast("double")
    base = df.filter(x.isNotNull() & ~F.isnan(x))
    low, high, n = base.agg(F.min(x), F.max(x), F.count("*")).first()
    if low is None or low == high or (not yeo_johnson and low <= 0):
        return None
    jacobian, middle = (base.agg(F.sum(F.signum(x) * F.ln(F.abs(x) + 1))).first()[0], 0.0) if yeo_johnson else (0.0, base.agg(F.avg(F.ln(x))).first()[0])

    def moved(lam: float) -> Column:
        """What has the variance that counts. For Box-Cox by powers of x over its geometric mean, without the 1 in which small powers would drown."""
        if yeo_johnson:
            return power(x, lam, True)
        return F.ln(x) if abs(lam) < 1e-12 else F.exp(lam * (F.ln(x) - middle)) / lam

    centre, step, widest = 1.0, 0.5, 1e3
    while step > within:
        grid = [centre + k * step for k in range(-8, 9)]
        r = base.agg(*[F.var_pop(moved(lam)).alias(f"v{k}") for k, lam in enumerate(grid)]).first()
        score = {k: -n / 2 * math.log(r[f"v{k}"]) + (lam - 1) * jacobian for k, lam in enumerate(grid) if r[f"v{k}"] and math.isfinite(r[f"v{k}"])}
        if not score:
            return None
        best = max(score, key=score.get)
        at_end = best in (min(score), max(score))
        centre = grid[best]
        if at_end and best in (0, len(grid) - 1) and step < widest:
            step *= 2  # the best lies beyond the grid
        else:
            step /= 4
    return round(centre, 6)


def power(x: Column, lam: float, yeo_johnson: bool = False) -> Column:
    def box(y: Column, p: float) -> Column:
        return F.ln(y) if abs(p) < 1e-12 else (F.pow(y, F.lit(p)) - 1) / p

    return F.when(x >= 0, box(x + 1, lam)).otherwise(-box(1 - x, 2 - lam)) if yeo_johnson else box(x, lam)


def transform_distribution(df: DataFrame, column: str, method: str = "log", offset: float = 0.0, new: str | None = None) -> DataFrame:
    x = quoted(column)
    if method in ("log", "sqrt"):
        return df.withColumn(new or column, (log_offset if method == "log" else sqrt_offset)(x, offset))
    if method in ("box-cox", "yeo-johnson"):
        lam = box_cox_lambda(df, column, method == "yeo-johnson")
        return df if lam is None else df.withColumn(new or column, power(x.cast("double"), lam, method == "yeo-johnson"))
    return df


def impute(df: DataFrame, method: str = "simple_median", columns: list[str] | None = None, k: int = 5, rounds: int = 3) -> DataFrame:
    """simple_mean, simple_median, auto (median), knn (mean of the k nearest rows without gaps), mice and missforest (rounds of regressions)."""
    names = columns or numeric_columns(df, SKIP)
    if method in ("simple_mean", "simple_median", "auto"):
        fill = df.agg(*[F.avg(quoted(c)).alias(c) for c in names]).first() if names and method == "simple_mean" else column_medians(df, names)
        return df.withColumns({c: F.coalesce(quoted(c).cast("double"), F.lit(fill[c])) for c in names if fill[c] is not None}) if names else df
    if method in ("mice", "missforest"):
        return _iterative(df, names, rounds, method == "missforest")
    if method == "knn":
        # Where no row is without gaps the median is left.
        return impute(neighbours.impute_nearest(df, names, k), "simple_median", names) if names else df
    raise ValueError(f"unknown imputation {method}")


class TrainImputer:
    """Means or medians of the training rows, for their gaps and those of any other rows. Columns that hold no training value leave."""

    def __init__(self, kind: str = "mean"):
        if kind not in ("mean", "median"):
            raise ValueError(f"unknown imputation {kind}")
        self.kind, self.fill, self.dropped = kind, {}, []

    def fit(self, train: DataFrame, columns: list[str] | None = None) -> TrainImputer:
        names = columns or numeric_columns(train, SKIP)
        found = {}
        if names:
            found = column_medians(train, names) if self.kind == "median" else train.agg(*[F.avg(quoted(c)).alias(c) for c in names]).first()
        self.fill = {c: float(found[c]) for c in names if found[c] is not None}
        self.dropped = [c for c in names if c not in self.fill]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        own = {c: F.coalesce(quoted(c).cast("double"), F.lit(v)) for c, v in self.fill.items() if c in df.columns}
        return (df.withColumns(own) if own else df).drop(*self.dropped)

    def fit_transform(self, train: DataFrame, test: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        self.fit(train, columns)
        return self.transform(train), self.transform(test)


def _iterative(df: DataFrame, names: list[str], rounds: int, forest: bool) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    flags = {f"_na{k}": quoted(c).isNull() for k, c in enumerate(names)}
    full = impute(df.withColumns(flags), "simple_median", names)
    missing = df.agg(*[F.count_if(quoted(c).isNull()).alias(c) for c in names]).first()
    for _ in range(rounds):
        for k, c in enumerate(names):
            if not missing[c] or len(names) < 2:
                continue
            rows = VectorAssembler(inputCols=[x for x in names if x != c], outputCol="_x", handleInvalid="keep").transform(full)
            model = (RandomForestRegressor(numTrees=20, seed=42) if forest else LinearRegression(regParam=1e-6)).setParams(featuresCol="_x", labelCol=c, predictionCol="_p")
            rows = model.fit(rows.filter(~F.col(f"_na{k}"))).transform(rows)
            full = rows.withColumn(c, F.when(F.col(f"_na{k}"), F.col("_p")).otherwise(quoted(c))).drop("_x", "_p")
    return full.drop(*flags)


def encode(df: DataFrame, column: str, method: str = "safe_target", target: str | None = None, smoothing: float = 10.0, order_by: str | None = None) -> DataFrame:
    """ordinal, label, frequency, safe_target (out of fold), catboost (ordered), leave_one_out."""
    x = quoted(column)
    if method in ("ordinal", "label"):
        # Values are put in order by ranges of them; a range's first code is the number of values before it.
        values = df.select(x.cast("string").alias("_v")).filter("_v is not null").distinct()
        ranged = settled(values.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "ordered-values")
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        first = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("_v")) - 1
        codes = ranged.join(F.broadcast(first), "_part").select("_v", (F.col("_first") + place).cast("int").alias("_code"))
        return df.join(codes, x.cast("string") == F.col("_v"), "left").withColumn(column, F.coalesce("_code", F.lit(-1))).drop("_v", "_code")
    if method == "frequency" or target is None:
        counts = df.filter(x.isNotNull()).groupBy(x.alias("_v")).agg(F.count("*").alias("_n"))
        total = df.agg(F.count(x)).first()[0] or 1
        return df.join(counts, x == F.col("_v"), "left").withColumn(column, F.col("_n") / F.lit(total)).drop("_v", "_n")
    y = quoted(target).cast("double")
    prior = df.agg(F.avg(y)).first()[0]
    if method == "catboost":
        # Sums over a category's rows up to each row, in range buckets of the order, so that no task holds a category.
        order = quoted(order_by) if order_by else F.xxhash64(*[quoted(c) for c in df.columns])
        rows = df.withColumns({"_none": x.isNull(), "_value": F.coalesce(x.cast("string"), F.lit("")), "_order": order, "_y": F.coalesce(y, F.lit(0.0)), "_c": y.isNotNull().cast("int")})
        summed = running_sums(rows, "_order", {"_sy": "_y", "_sc": "_c"}, ["_none", "_value"])
        return summed.withColumn(column, (F.col("_sy") - F.col("_y") + prior) / (F.col("_sc") - F.col("_c") + 1)).select(*[quoted(c) for c in df.columns])
    if method == "leave_one_out":
        sums = df.groupBy(x.alias("_v")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        return df.join(sums, x.eqNullSafe(F.col("_v")), "left").withColumn(column, F.coalesce(safe_divide(F.col("_s") - y, F.col("_n") - 1), F.lit(prior))).drop("_v", "_s", "_n")
    if method == "safe_target":
        fold = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(5))
        rows = df.withColumn("_fold", fold)
        by = rows.groupBy(x.alias("_v"), F.col("_fold").alias("_f")).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        total = by.groupBy("_v").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
        rates = by.join(total, "_v").select("_v", "_f", ((F.col("_ts") - F.coalesce("_s", F.lit(0.0)) + smoothing * prior) / (F.col("_tn") - F.col("_n") + smoothing)).alias("_r"))
        return rows.join(rates, (x == F.col("_v")) & (F.col("_fold") == F.col("_f")), "left").withColumn(column, F.coalesce("_r", F.lit(prior))).drop("_fold", "_v", "_f", "_r")
    raise ValueError(f"unknown encoding {method}")


def balance(df: DataFrame, target: str = TARGET, method: str = "random_over", seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """random_over, random_under; smote (auto) and adasyn among the nearest rows of a class; smoteenn and smotetomek clean up after smote."""
    if target not in df.columns:
        return df
    if method in ("auto", "smote", "adasyn", "smoteenn", "smotetomek"):
        names = columns or numeric_columns(df, (*SKIP, target))
        if not names:
            return df
        grown = neighbours.oversample(df, target, names, "adasyn" if method == "adasyn" else "smote", seed=seed)
        if method == "smoteenn":
            return neighbours.edited(grown, target, names)
        return neighbours.without_tomek_links(grown, target, names) if method == "smotetomek" else grown
    sizes = {r[0]: r[1] for r in df.filter(quoted(target).isNotNull()).groupBy(target).count().collect()}
    if not sizes:
        return df
    low, high = min(sizes.values()), max(sizes.values())
    own = F.xxhash64(*[quoted(c) for c in df.columns], F.lit(seed))
    n = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[quoted(target)]
    # Ranks within a class are counted in hashed cells of it, so that no task sees a whole class.
    cells = 64
    keyed = df.filter(quoted(target).isNotNull()).withColumns({"_h": own, "_cell": F.pmod(own, F.lit(cells))})
    per = keyed.groupBy(target, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(target).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col(target).alias("_t"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = keyed.join(offsets, (quoted(target) == F.col("_t")) & (F.col("_cell") == F.col("_c"))).withColumn("_rank", F.row_number().over(Window.partitionBy(target, "_cell").orderBy("_h")) + F.col("_o"))
    if method == "random_under":
        return ranked.filter(F.col("_rank") <= low).select(*df.columns)
    times = F.floor(F.lit(high) / n) + (F.col("_rank") <= F.lit(high) % n).cast("int")
    if method == "random_over":
        return ranked.withColumn("_k", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*df.columns)
    raise ValueError(f"unknown balancing {method}")


def interactions(df: DataFrame, method: str = "polynomial", columns: list[str] | None = None) -> DataFrame:
    names = columns or numeric_columns(df, SKIP)
    if len(names) < 2:
        return df
    if method == "polynomial":
        return polynomial(df, names, 2, interaction_only=True)
    out = {}
    for a, b in itertools.combinations(names, 2):
        x, y = quoted(a), quoted(b)
        out |= {f"{a}_plus_{b}": x + y, f"{a}_minus_{b}": x - y, f"{a}_times_{b}": x * y, f"{a}_over_{b}": safe_divide(x, y)}
    return df.withColumns({k: v for k, v in out.items() if k not in df.columns})


class FeatureEngineer:
    """The transforms as a chain; ``summary`` counts the columns each added."""

    _STEPS = {"one_hot_encode": one_hot, "handle_pipe_separated_column": pipe_separated, "apply_custom_transformation": transform_column, "scale_numeric_features": scale, "engineer_polynomial_features": polynomial, "transform_numeric_distribution": transform_distribution, "impute": impute, "encode": encode, "balance_classes": balance, "create_interactions": interactions}

    def __init__(self, df: DataFrame):
        self.df, self._log = df, []

    def __getattr__(self, name: str):
        step = FeatureEngineer._STEPS.get(name)
        if step is None:
            raise AttributeError(name)

        def run(*args, **kwargs):
            before = set(self.df.columns)
            self.df = step(self.df, *args, **kwargs)
            self._log.append((name, [c for c in self.df.columns if c not in before]))
            return self

        return run

    def summary(self, shown: int = 10) -> dict:
        return {"columns": len(self.df.columns), "new_features": sum(len(c) for _, c in self._log), "steps": [{"step": n, "added": len(c), "names": c[:shown]} for n, c in self._log]}
