"""Exact nearest neighbours (Euclidean), and what is built on them: imputation, SMOTE, ADASYN, edited neighbours, Tomek links, classification.

Rows are put into a tree of boxes, level by level: each box with more than ``LEAF`` rows is cut into up to 16 along its widest column, at
quantiles of its own, in one aggregate for all boxes of a level. A query goes down to the nearest leaf that has enough rows; the kth
distance there bounds what it looks for, and it goes down again to every leaf whose box is not farther than that. So the result is certain
after two descents. Descents are joins by box, leaves are compared with their queries in one task each, the queries of a much visited
leaf in several. No task holds more than a leaf and ``VISITS`` queries; the driver holds no rows, boxes or distances.

Of equal rows only the first k + 1 enter the tree, so copies neither fill a leaf nor keep it from being cut. How many leaves a query
visits grows with the number of columns: with many columns the search nears a comparison with every row.

Defined cases: rows and queries with a missing value are left out; at equal distance the least id comes first; with fewer than k rows
all of them are found; empty tables give an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from ..session import broadcast_if_small, settled

LEAF = 1000
FAN = 16
DEPTH = 14
VISITS = 20_000


def _xs(d: int, letter: str = "x") -> list[str]:
    return [f"{letter}{j}" for j in range(d)]


@dataclass
class BoxTree:
    """leaves: _node, r, x0, x1, ...; kids: parent and up to 16 children, each with its box, rows and whether it is a leaf."""

    leaves: DataFrame
    kids: DataFrame
    d: int
    k: int


def box_tree(rows: DataFrame, key: str, columns: list[str], k: int, leaf: int = LEAF) -> BoxTree:
    """The tree of ``rows`` for searches of up to ``k`` neighbours. key: a column of different integers."""
    d, leaf = len(columns), max(leaf, FAN * (k + 2))
    xs = _xs(d)
    points = rows.select(quoted(key).cast("bigint").alias("r"), *[quoted(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)]).dropna()
    copy = F.row_number().over(Window.partitionBy(*xs).orderBy("r"))
    live = settled(points.withColumn("_c", copy).filter(F.col("_c") <= k + 1).select(F.lit(1).cast("bigint").alias("_node"), "r", *xs), "tree")
    levels, done = [], []
    for depth in range(DEPTH + 1):
        edges = [c for x in xs for c in (F.min(x).alias(f"lo_{x}"), F.max(x).alias(f"hi_{x}"))]
        boxes = settled(live.groupBy("_node").agg(F.count("*").alias("n"), *edges), "boxes")
        boxes = boxes.withColumn("leaf", (F.col("n") <= leaf) if depth < DEPTH else F.lit(True))
        levels.append(boxes)
        done.append(live.join(broadcast_if_small(boxes.filter("leaf").select("_node")), "_node", "left_semi"))
        big = boxes.filter("not leaf")
        if big.isEmpty():
            break
        widths = F.array(*[F.col(f"hi_{x}") - F.col(f"lo_{x}") for x in xs])
        at = (F.array_position(widths, F.array_max(widths)) - 1).cast("int")
        pick = lambda side, at=at: F.get(F.array(*[F.col(f"{side}_{x}") for x in xs]), at)
        cut = live.join(broadcast_if_small(big.select("_node", at.alias("_at"), pick("lo").alias("_lo"), pick("hi").alias("_hi"))), "_node").withColumn("_v", F.get(F.array(*xs), F.col("_at")))
        found = cut.groupBy("_node").agg(F.percentile_approx("_v", [j / FAN for j in range(1, FAN)], 1000).alias("_p"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        middle = (F.col("_lo") + F.col("_hi")) / 2
        bounds = F.array_distinct(F.filter("_p", lambda p: p > F.col("_lo")))
        # Where nearly all rows have the least value, the rest is cut off.
        bounds = F.when(F.size(bounds) > 0, bounds).otherwise(F.array(F.when(middle > F.col("_lo"), middle).otherwise(F.col("_hi"))))
        held = broadcast_if_small(settled(found.select("_node", bounds.alias("_b")), "cuts"))
        child = F.col("_node") * FAN + F.size(F.filter("_b", lambda b: b <= F.col("_v")))
        live = settled(cut.select("_node", "r", *xs, "_v").join(held, "_node").select(child.alias("_node"), "r", *xs), "tree")
    nodes = functools.reduce(DataFrame.unionByName, levels)
    parent = F.when(F.col("_node") > 1, F.floor(F.col("_node") / FAN).cast("bigint")).otherwise(0)
    kid = F.struct(F.col("_node").alias("node"), "leaf", "n", *[f"{side}_{x}" for x in xs for side in ("lo", "hi")])
    kids = settled(nodes.groupBy(parent.alias("_parent")).agg(F.collect_list(kid).alias("_kids")), "kids")
    return BoxTree(settled(functools.reduce(DataFrame.unionByName, done), "leaves"), kids, d, k)


def _away(kid: Column, xs: list[str]) -> Column:
    """Squared distance of the query's point from a box."""
    return functools.reduce(lambda a, b: a + b, [F.pow(F.greatest(kid[f"lo_{x}"] - F.col(x), F.col(x) - kid[f"hi_{x}"], F.lit(0.0)), F.lit(2.0)) for x in xs])


def _descend(tree: BoxTree, queries: DataFrame, pick) -> DataFrame:
    """(columns of queries, _node): the leaves that queries come to, going on to the children that ``pick`` chooses."""
    kids, names, live, out = broadcast_if_small(tree.kids), queries.columns, queries.withColumn("_node", F.lit(0).cast("bigint")), []
    for _ in range(DEPTH + 1):
        chosen = live.join(kids, F.col("_node") == F.col("_parent")).select(*names, F.explode(pick("_kids")).alias("_to"))
        chosen = settled(chosen.select(*names, F.col("_to.node").alias("_node"), F.col("_to.leaf").alias("_leaf")), "descent")
        out.append(chosen.filter("_leaf").drop("_leaf"))
        live = chosen.filter("not _leaf").drop("_leaf")
        if live.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, out)


def _compare(tree: BoxTree, visits: DataFrame, k: int, other: bool) -> DataFrame:
    """(q, r, d2): of each visit the k nearest rows of its leaf."""
    xs = _xs(tree.d)
    counts = settled(visits.groupBy("_node").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("_parts")), "visits")
    counts = broadcast_if_small(counts)
    left = visits.join(counts, "_node").withColumn("_part", F.pmod(F.xxhash64("q"), F.col("_parts"))).drop("_parts")
    right = tree.leaves.join(counts, "_node").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts").cast("bigint") - 1))).drop("_parts")

    def best(_, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("r")
        r, points, q, wanted = rows.r.to_numpy(), rows[xs].to_numpy(), asked.q.to_numpy(), asked[xs].to_numpy()
        found = []
        for low in range(0, len(q) if len(r) else 0, 256):
            part = wanted[low : low + 256]
            d2 = np.zeros((len(part), len(r)))
            for j in range(len(xs)):
                d2 += (part[:, j, None] - points[None, :, j]) ** 2
            if other:
                d2[q[low : low + 256, None] == r[None, :]] = np.inf
            near = np.argsort(d2, axis=1, kind="stable")[:, :k]
            own = np.take_along_axis(d2, near, 1)
            at = np.isfinite(own)
            found.append(pd.DataFrame({"q": np.repeat(q[low : low + 256], at.sum(1)), "r": r[near[at]], "d2": own[at]}))
        return pd.concat(found) if found else pd.DataFrame({"q": np.zeros(0, np.int64), "r": np.zeros(0, np.int64), "d2": np.zeros(0)})

    return left.groupBy("_node", "_part").cogroup(right.groupBy("_node", "_part")).applyInPandas(best, "q bigint, r bigint, d2 double")


def nearest(tree: BoxTree, queries: DataFrame, key: str, columns: list[str], k: int | None = None, other: bool = False) -> DataFrame:
    """(q, r, d2, place): the k nearest rows of each query, place from 1. other: a row with the query's id does not count."""
    k = k or tree.k
    xs = _xs(tree.d)
    asked = queries.select(quoted(key).cast("bigint").alias("q"), *[quoted(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)]).dropna()
    asked = settled(asked, "queries")

    def closest(kids):
        enough = F.filter(kids, lambda c: c["n"] > k)
        among = F.when(F.size(enough) > 0, enough).otherwise(F.col(kids))
        return F.array(F.array_min(F.transform(among, lambda c: F.struct(_away(c, xs).alias("d"), c["node"].alias("node"), c["leaf"].alias("leaf")))))

    first = _compare(tree, _descend(tree, asked, closest), k, other)
    bounds = first.groupBy("q").agg(F.when(F.count("*") >= k, F.max("d2")).alias("_bound"))
    # A hair more than the bound, so that rounding of box distances loses nothing.
    bounded = asked.join(bounds, "q", "left").withColumn("_bound", F.coalesce(F.col("_bound") * (1 + 1e-9) + 1e-300, F.lit(float("inf"))))
    visits = _descend(tree, bounded, lambda kids: F.filter(kids, lambda c: _away(c, xs) <= F.col("_bound")))
    place = F.row_number().over(Window.partitionBy("q").orderBy("d2", "r"))
    return _compare(tree, visits.drop("_bound"), k, other).withColumn("place", place).filter(F.col("place") <= k)


def numbered(df: DataFrame) -> DataFrame:
    """``df``, written down, with ``_id``, different integers."""
    return settled(df.withColumn("_id", F.monotonically_increasing_id()), "numbered")


def standardised(df: DataFrame, columns: list[str], like: DataFrame | None = None) -> DataFrame:
    """``df`` with z0, z1, ...: the columns by mean and deviation (of ``like``), 0 where missing or constant."""
    m = (df if like is None else like).agg(*[f(quoted(c)).alias(f"{n}{j}") for j, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({f"z{j}": F.coalesce((quoted(c).cast("double") - F.lit(m[f"m{j}"])) / F.lit(m[f"s{j}"] or None), F.lit(0.0)) for j, c in enumerate(columns)})


def impute_nearest(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Missing values become the mean of the k nearest rows without gaps, by standardised columns; gaps stand at the mean in the distance."""
    zs = _xs(len(columns), "z")
    rows = standardised(numbered(df), columns)
    whole = functools.reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in columns])
    found = nearest(box_tree(rows.filter(whole), "_id", zs, k), rows.filter(~whole), "_id", zs)
    donors = rows.select(F.col("_id").alias("r"), *[quoted(c).cast("double").alias(f"_v{j}") for j, c in enumerate(columns)])
    means = found.join(donors, "r").groupBy(F.col("q").alias("_id")).agg(*[F.avg(f"_v{j}").alias(f"_f{j}") for j in range(len(columns))])
    out = rows.join(means, "_id", "left").withColumns({c: F.coalesce(quoted(c).cast("double"), F.col(f"_f{j}")) for j, c in enumerate(columns)})
    return out.select(*[quoted(c) for c in df.columns])


def _share(*parts) -> Column:
    """A number from 0 to below 1 that follows from ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _interpolated(rows: DataFrame, wanted: DataFrame, near: DataFrame, columns: list[str], names: list[str], seed: int) -> DataFrame:
    """New rows: for each (_id, _n) as many points between the row and neighbours of it, drawn by hash; other columns are the row's."""
    lists = near.groupBy(F.col("q").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("place", "r"))).alias("_near"))  # k of them
    drawn = wanted.filter("_n > 0").join(lists, "_id").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    drawn = drawn.withColumns({"_to": F.get("_near", F.floor(_share("_id", "_k", F.lit(seed)) * F.size("_near")).cast("int"))["r"], "_gap": _share("_id", "_k", F.lit(seed + 1))})
    ends = rows.select(F.col("_id").alias("_to"), *[quoted(c).cast("double").alias(f"_e{j}") for j, c in enumerate(columns)])
    made = drawn.select("_id", "_to", "_gap").join(rows, "_id").join(ends, "_to")
    return made.withColumns({c: quoted(c).cast("double") + F.col("_gap") * (F.col(f"_e{j}") - quoted(c).cast("double")) for j, c in enumerate(columns)}).select(*[quoted(c) for c in names])


def _counts(rows: DataFrame, target: str) -> dict:
    return {r[0]: r[1] for r in rows.filter(quoted(target).isNotNull()).groupBy(target).count().collect()}  # a row a class


def oversample(df: DataFrame, target: str, columns: list[str], method: str = "smote", k: int = 5, seed: int = 42) -> DataFrame:
    """Every class grows to the size of the largest by points between its rows and their k nearest rows of the same class.

    smote: each row starts as many new ones, give or take one. adasyn: in proportion to the share of other classes among its k nearest rows
    of any class, rounded; a class that no other reaches does not grow. Classes of one row do not grow; rows without a class or with
    a gap in ``columns`` stay as they are. Columns of ``columns`` become doubles.
    """
    rows = numbered(df.withColumns({c: quoted(c).cast("double") for c in columns}))
    sizes = _counts(rows, target)
    if len(sizes) < 2:
        return rows.drop("_id")
    most, zs = max(sizes.values()), _xs(len(columns), "z")
    scaled, out = standardised(rows, columns), [rows.drop("_id")]
    complete = scaled.filter(functools.reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in columns]))
    around = box_tree(complete, "_id", zs, k) if method == "adasyn" else None
    for label, n in sorted(sizes.items(), key=repr):
        own = complete.filter(quoted(target) == F.lit(label))
        if n == most or n < 2:
            continue
        if method == "smote":
            total = own.count()
            order = F.row_number().over(Window.partitionBy("_cell").orderBy("_h"))
            cells = max(1, total // 50_000)
            keyed = own.select("_id", F.xxhash64("_id", F.lit(seed)).alias("_h")).withColumn("_cell", F.pmod("_h", F.lit(cells)))
            # What does not divide evenly goes to the first rows of each hashed cell, its share by size, the last cell's end by running sum.
            per = keyed.groupBy("_cell").agg(F.count("*").alias("_c"))
            upto = F.sum("_c").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row a cell
            per = per.select("_cell", (upto - F.col("_c")).alias("_before"))
            ranked = keyed.join(F.broadcast(per), "_cell").withColumn("_rank", order + F.col("_before"))
            even, rest = divmod(most - n, total) if total else (0, 0)
            wanted = ranked.select("_id", (F.lit(even) + (F.col("_rank") <= rest).cast("int")).alias("_n"))
        else:
            labels = complete.select(F.col("_id").alias("r"), quoted(target).alias("_y"))
            hard = nearest(around, own, "_id", zs, k, other=True).join(labels, "r").groupBy(F.col("q").alias("_id")).agg((F.count_if(F.col("_y") != F.lit(label)) / F.count("*")).alias("_w"))
            hard = settled(hard, "hardness")
            weight = hard.agg(F.coalesce(F.sum("_w"), F.lit(0.0))).first()[0]
            if not weight:
                continue
            wanted = hard.select("_id", F.bround(F.col("_w") / F.lit(weight) * (most - n)).cast("int").alias("_n"))
        near = nearest(box_tree(own, "_id", zs, k), own, "_id", zs, other=True)
        out.append(_interpolated(rows, wanted, near, columns, df.columns, seed))
    return functools.reduce(DataFrame.unionByName, out)


def edited(df: DataFrame, target: str, columns: list[str], k: int = 3) -> DataFrame:
    """``df`` without rows whose k nearest rows are not all of their class. Rows without a class or with a gap stay."""
    rows = standardised(numbered(df), columns)
    zs = _xs(len(columns), "z")
    complete = rows.filter(functools.reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in [*columns, target]]))
    found = nearest(box_tree(complete, "_id", zs, k), complete, "_id", zs, other=True)
    label = lambda name, y: complete.select(F.col("_id").alias(name), quoted(target).alias(y))
    foreign = found.join(label("r", "_ry"), "r").join(label("q", "_qy"), "q").filter("_ry <> _qy").select(F.col("q").alias("_id")).distinct()
    return rows.join(foreign, "_id", "left_anti").select(*[quoted(c) for c in df.columns])


def without_tomek_links(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """``df`` without the pairs of rows of different classes that are each other's nearest."""
    rows = standardised(numbered(df), columns)
    zs = _xs(len(columns), "z")
    complete = rows.filter(functools.reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in [*columns, target]]))
    near = settled(nearest(box_tree(complete, "_id", zs, 1), complete, "_id", zs, other=True).select("q", "r"), "nearest")
    mutual = near.join(near.select(F.col("q").alias("r"), F.col("r").alias("q")), ["q", "r"])
    label = lambda name, y: complete.select(F.col("_id").alias(name), quoted(target).alias(y))
    linked = mutual.join(label("r", "_ry"), "r").join(label("q", "_qy"), "q").filter("_ry <> _qy").select(F.col("q").alias("_id"))
    return rows.join(linked, "_id", "left_anti").select(*[quoted(c) for c in df.columns])


def vote(train: DataFrame, rows: DataFrame, target: str, columns: list[str], k: int = 5) -> DataFrame:
    """``rows`` with ``prediction``, the commonest class of the k nearest rows of ``train`` (the least of several), and ``share``, its part of them.

    Columns are standardised by ``train``. Rows of ``train`` without a class do not vote.
    """
    zs = _xs(len(columns), "z")
    known = standardised(numbered(train.filter(quoted(target).isNotNull()).select(*[quoted(c) for c in columns], quoted(target).alias("_y"))), columns)
    asked = standardised(numbered(rows), columns, like=known)
    found = nearest(box_tree(known, "_id", zs, k), asked, "_id", zs).join(known.select(F.col("_id").alias("r"), "_y"), "r")
    votes = found.groupBy("q", "_y").agg(F.count("*").alias("_n"))
    best = votes.groupBy(F.col("q").alias("_id")).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_y"))).alias("_b"), F.sum("_n").alias("_all"))
    out = asked.join(best, "_id", "left")
    return out.select(*[quoted(c) for c in rows.columns], F.col("_b._y").alias("prediction"), (-F.col("_b.n") / F.col("_all")).alias("share"))


def relief_scores(df: DataFrame, target: str, columns: list[str]) -> list[float]:
    """Of each column, scaled by its range: the distance to the nearest row of another class less that to the nearest of the own, summed over all rows."""
    m = df.agg(*[f(quoted(c).cast("double")).alias(f"{n}{j}") for j, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    zs = _xs(len(columns), "z")
    gap = lambda j: (m[f"b{j}"] or 0.0) - (m[f"a{j}"] or 0.0)
    rows = numbered(df.filter(quoted(target).isNotNull()).fillna(0, columns).withColumns({f"z{j}": (quoted(c).cast("double") - F.lit(m[f"a{j}"] or 0.0)) / F.lit(gap(j) or 1.0) for j, c in enumerate(columns)}))
    score = np.zeros(len(columns))
    ends = rows.select(F.col("_id").alias("r"), *[F.col(z).alias(f"e{z}") for z in zs])
    for label in sorted(_counts(rows, target), key=repr):
        own, rest = rows.filter(quoted(target) == F.lit(label)), rows.filter(quoted(target) != F.lit(label))
        hit = nearest(box_tree(own, "_id", zs, 1), own, "_id", zs, other=True).select("q", F.col("r").alias("hit"))
        miss = nearest(box_tree(rest, "_id", zs, 1), own, "_id", zs).select("q", F.col("r").alias("miss"))
        both = hit.join(miss, "q")
        side = lambda name, sign: both.select("q", F.col(name).alias("r")).join(ends, "r").join(own.select(F.col("_id").alias("q"), *zs), "q").agg(*[F.coalesce(F.sum(sign * F.abs(F.col(z) - F.col(f"e{z}"))), F.lit(0.0)) for z in zs]).first()  # noqa: E731, B023
        score += np.array(side("miss", 1.0), float) + np.array(side("hit", -1.0), float)
    return score.tolist()
