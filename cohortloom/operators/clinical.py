"""Clinical helpers and the relational queries of the study guide."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted

# Levodopa-equivalent factors.
LEDD_FACTORS = {"levodopa_ir": 1.0, "levodopa_cr": 0.75, "levodopa_entacapone": 1.33, "pramipexole": 100, "ropinirole": 20, "rotigotine": 30, "apomorphine": 10, "rasagiline": 100, "selegiline_oral": 10, "selegiline_sublingual": 80, "safinamide": 100, "amantadine": 1.0, "tolcapone": 0.5, "entacapone": 0.33}
# Name fragments of levodopa drugs.
LEVODOPA_NAMES = ("LEV", "DOP", "RYTA", "MADOPAR", "SINEMET", "STANEK", "STALEVO", "ISICOM", "INBRIJA", "NACOM", "PROLOPA")
# Subgroups in order of precedence.
SUBGROUPS = ("PINK1", "PARKIN", "SRDC", "HPSM", "RBD", "LRRK2", "SNCA", "GBA")


def null_strict_sum(columns: list[str]) -> Column:
    return functools.reduce(lambda a, b: a + b, [quoted(c) for c in columns])


def aggregate_updrs(df: DataFrame, part1=None, part2=None, part3=None, part4=None) -> DataFrame:
    """Sums of the parts given, NULL where an item is; part 3 is updrs_motor; the total is over what is given."""
    parts = {n: c for n, c in (("updrs_part1", part1), ("updrs_part2", part2), ("updrs_motor", part3), ("updrs_part4", part4)) if c}
    out = df.withColumns({n: null_strict_sum(c) for n, c in parts.items()})
    return out.withColumn("updrs_total", null_strict_sum(list(parts))) if parts else out


def hoehn_yahr_summary(df: DataFrame, column: str) -> DataFrame:
    """(stage, count, proportion, n, median, mean)"""
    v = df.select(quoted(column).cast("double").alias("stage")).dropna()
    counts = v.groupBy("stage").agg(F.count("*").alias("count"))
    # Stages are few: their counts give the rest.
    total = counts.agg(F.sum("count").alias("n"), F.percentile("stage", F.lit(0.5), F.col("count")).alias("median"), (F.sum(F.col("stage") * F.col("count")) / F.sum("count")).alias("mean"))
    return counts.join(F.broadcast(total), F.lit(True)).select("stage", "count", (F.col("count") / F.col("n")).alias("proportion"), "n", "median", "mean")  # total: one row


def compute_ledd(doses: DataFrame, drug: str = "drug", dose: str = "dose", by: list[str] | None = None, factors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(total by ``by``, per-drug records); unknown drugs have no factor and add nothing."""
    pairs = [F.lit(x) for k, v in (factors or LEDD_FACTORS).items() for x in (k, float(v))]
    rows = doses.withColumn("factor", F.try_element_at(F.create_map(*pairs), quoted(drug))).withColumn("ledd", quoted(dose).cast("double") * F.col("factor"))
    rows = rows.withColumn("note", F.when(F.col("factor").isNull(), F.lit("unknown drug")))
    return rows.groupBy(*(by or [])).agg(F.coalesce(F.sum("ledd"), F.lit(0.0)).alias("total_ledd")), rows


def subgroup_counts(df: DataFrame, cohort: str, flags: dict[str, str], definition: str | None = None) -> DataFrame:
    """Cohort by genetic subgroup; flags maps subgroup names to 0/1 columns. More than one flag is 'Multiple factors'."""
    total = functools.reduce(lambda a, b: a + b, [quoted(c) for c in flags.values()])
    group = F.when(total > 1, "Multiple factors")
    for name in [s for s in SUBGROUPS if s in flags] + [s for s in flags if s not in SUBGROUPS]:
        group = group.when(quoted(flags[name]) == 1, name)
    return df.groupBy(quoted(cohort).alias("cohort"), group.alias("subgroup")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "cohort", F.col("subgroup").asc_nulls_first())


def point_in_time_sums(intervals: DataFrame, values: dict[str, Column], subject: str = "subject", start: str = "start", stop: str = "stop", months_after: int = 1) -> DataFrame:
    """(subject, t, a sum for each of ``values``) at every change date: starts, and ``months_after`` months after stops.

    Intervals are closed, an open end lasts; one that stops before it starts adds its dates and nothing else. Changes are added
    and subtracted in order of date, a running sum within the subject: an interval is two rows, where a range join would
    make a row for each date it spans, and all sums share one shuffle.
    """
    names = list(values)
    x = intervals.select(quoted(subject).alias("subject"), quoted(start).cast("date").alias("s"), quoted(stop).cast("date").alias("e"), *[F.coalesce(v.try_cast("double"), F.lit(0.0)).alias(f"v{k}") for k, v in enumerate(values.values())])
    x = x.withColumn("holds", F.coalesce(F.col("e") >= F.col("s"), F.col("s").isNotNull()))
    # An interval counts at dates s <= t <= e: it enters at s and leaves at the first date after e.
    step = lambda t, sign, shown: F.struct(t.alias("t"), F.lit(shown).alias("shown"), *[(F.when(F.col("holds"), sign * F.col(f"v{k}")).otherwise(0.0)).alias(f"v{k}") for k in range(len(names))])
    steps = F.array(step(F.col("s"), 1.0, True), step(F.date_add("e", 1), -1.0, False), step(F.add_months("e", months_after), 0.0, True))
    rows = x.select("subject", F.explode(steps).alias("x")).select("subject", "x.*").filter("t is not null")
    daily = rows.groupBy("subject", "t").agg(F.max("shown").alias("shown"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(names))])
    running = Window.partitionBy("subject").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = daily.select("subject", "t", "shown", *[F.sum(f"v{k}").over(running).alias(n) for k, n in enumerate(names)])
    return totals.filter("shown").select("subject", "t", *names)


def point_in_time_dose(intervals: DataFrame, subject: str = "subject", start: str = "start", stop: str = "stop", dose: str = "dose", months_after: int = 1) -> DataFrame:
    """(subject, t, total): total dose at every change date."""
    return point_in_time_sums(intervals, {"total": quoted(dose)}, subject, start, stop, months_after)


def ledd_terms(text: Column) -> tuple[Column, Column, Column]:
    """(fixed dose, factor of levodopa, fixed addition under that factor) of a dose text: '100', 'LD x 0.33', '(150 + LD) x 0.33'."""
    fixed = text.try_cast("double")
    number = r"([0-9]*\.?[0-9]+)"
    alone = F.regexp_extract(text, rf"^\s*LD\s*[xX]\s*{number}\s*$", 1).try_cast("double")
    added = rf"^\s*\(\s*{number}\s*\+\s*LD\s*\)\s*[xX]\s*{number}\s*$"
    base, factor = (F.regexp_extract(text, added, k).try_cast("double") for k in (1, 2))
    return fixed, F.coalesce(alone, factor), base


def is_levodopa(name: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.upper(name).contains(x) for x in LEVODOPA_NAMES])


def total_ledd_at(meds: DataFrame, subject: str = "PATNO", drug: str = "LEDTRT", start: str = "STARTDT", stop: str = "STOPDT", ledd: str = "LEDD", amounts: tuple[str, str, str] | None = None) -> DataFrame:
    """(subject, t, levodopa, total) at every change date.

    The total is the fixed doses, plus factor times levodopa for each 'LD x f', plus f (b + levodopa) for each '(b + LD) x f' then in
    force. ``amounts`` names strength, dose and frequency, whose product stands for a levodopa drug's dose that is no number.
    """
    fixed, factor, base = ledd_terms(quoted(ledd))
    levodopa = is_levodopa(quoted(drug))
    if amounts:
        fixed = F.coalesce(fixed, F.when(levodopa, functools.reduce(lambda a, b: a * b, [quoted(c).try_cast("double") for c in amounts])))
    values = {"levodopa": F.when(levodopa, fixed), "_fixed": fixed, "_factor": factor, "_added": base * factor}
    sums = point_in_time_sums(meds, values, subject, start, stop)
    return sums.select("subject", "t", "levodopa", (F.col("_fixed") + F.col("_added") + F.col("_factor") * F.col("levodopa")).alias("total"))


def carry_forward(df: DataFrame, subject: str, order: str, columns: list[str]) -> DataFrame:
    upto = Window.partitionBy(subject).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(quoted(c), ignorenulls=True).over(upto) for c in columns})


def worst_stage(df: DataFrame, domains: list[str], name: str = "stage") -> DataFrame:
    return df.withColumn(name, F.greatest(*[quoted(c) for c in domains]))


# By project the fluorescence from which a replicate counts as raised, and from which as high (None: no such level).
ASSAY_LEVELS = {155: (5_000, None), 237: (3_000, 45_000)}
# By project, status by the numbers of high, of raised but not high, and of other replicates.
ASSAY_RULES = {
    155: {"Positive": ((0, 3, 0),), "Negative": ((0, 1, 2), (0, 0, 3)), "Inconclusive": ((0, 2, 1),)},
    237: {"Positive": ((3, 0, 0), (2, 1, 0), (1, 2, 0), (0, 3, 0), (0, 2, 1)), "Negative": ((1, 0, 2), (0, 1, 2), (0, 0, 3)), "Inconclusive": ((2, 0, 1), (1, 1, 1))},
}
# Type of a positive sample by its number of high replicates, for projects that have types.
ASSAY_TYPES = {237: {3: "Type 1", 2: "Undetermined", 1: "Type 2", 0: "Type 2"}}


def assay_status(df: DataFrame, replicates: list[str], project: str | int) -> DataFrame:
    """``df`` with ``status`` and ``assay_type`` by the decision table of each row's project.

    project: a column's name, or the one project of all rows. Types are given to positive samples of projects that have them, "NA" to
    their negative ones, null to inconclusive ones. A missing replicate or an unknown project gives null for both.
    """
    own = F.lit(project) if isinstance(project, int) else quoted(project).cast("int")
    status, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    known = functools.reduce(lambda a, b: a & b, [quoted(c).isNotNull() for c in replicates])
    number = lambda level: functools.reduce(lambda a, b: a + b, [(quoted(c) >= level).cast("int") for c in replicates]) if level is not None else F.lit(0)
    for name, (raised, high) in ASSAY_LEVELS.items():
        n_high, n_raised = number(high), number(raised)
        counts = F.struct(n_high, n_raised - n_high, F.lit(len(replicates)) - n_raised)
        here = known & (own == name)
        of_project = F.lit(None).cast("string")
        for outcome, cases in ASSAY_RULES[name].items():
            of_project = F.when(functools.reduce(lambda a, b: a | b, [counts == F.struct(*map(F.lit, c)) for c in cases]), outcome).otherwise(of_project)
        status = F.when(here, of_project).otherwise(status)
        if name in ASSAY_TYPES:
            of_high = F.try_element_at(F.create_map(*[F.lit(x) for pair in ASSAY_TYPES[name].items() for x in pair]), n_high)
            kind = F.when(here, F.when(of_project == "Positive", of_high).when(of_project == "Negative", "NA")).otherwise(kind)
    return df.withColumns({"status": status, "assay_type": kind})


# Codes of a positive synuclein test of the Lewy-body kind, of a positive dopamine test, of an SNCA variant.
S_POSITIVE, D_POSITIVE, G_SNCA = 1, 1, 3
# Lowest value of each functional stage: sum of the motor part, and of the non-motor part without its cognitive item.
MOTOR_STAGES = {3: 3, 4: 14, 5: 27, 6: 40}
NON_MOTOR_STAGES = {4: 13, 5: 25, 6: 37}
# Lowest normal score of the cognitive test, lowest sum of signs of subthreshold parkinsonism, highest percentile of a poor sense of smell.
MOCA_NORMAL, SUBTHRESHOLD_SIGNS, HYPOSMIA_PERCENTILE = 25, 5, 15
STAGE_FIELDS = ("s", "d", "g", "cognition", "moca", "signs", "motor", "non_motor", "medicated", "rbd", "smell")


def _at_least(value: Column, bounds: dict[int, int]) -> Column:
    """The highest stage whose bound ``value`` reaches, 0 if none; null for null."""
    stage = F.when(value.isNotNull(), 0)
    for name, bound in sorted(bounds.items()):
        stage = F.when(value >= bound, name).otherwise(stage)
    return stage


def synuclein_stage(df: DataFrame, subject: str, order: str, fields: dict[str, str]) -> DataFrame:
    """Each visit with ``nsd`` (1, 0 or null), ``stage`` ('0', '1A', ... '6' or null) and ``stage_number`` (0 to 6).

    fields: the columns of STAGE_FIELDS: synuclein, dopamine and genetic results; cognitive item (0 to 4); cognitive test; motor signs
    without tremor; motor sum; non-motor sum without the cognitive item; medicated and sleep disorder (0 or 1); percentile of smell.
    Missing values are carried forward from the subject's earlier visits. With a positive synuclein test the stage is 1 or 2 by
    symptoms, A or B by the dopamine result; with a positive dopamine result the worst of three domains is the stage if it is 3 or more. A
    missing domain leaves the stage open, unless another one reaches 6. A variant alone, with both tests negative, is stage 0.
    """
    names = {f: quoted(fields[f]) for f in STAGE_FIELDS}
    visits = df.withColumns({f"_{f}": c for f, c in names.items()})
    visits = carry_forward(visits, subject, order, [f"_{f}" for f in STAGE_FIELDS])
    s, d, g, item, moca, signs, motor, rest, medicated, rbd, smell = (F.col(f"_{f}") for f in STAGE_FIELDS)
    low = moca < MOCA_NORMAL
    # The item counts one stage more with a low test score; stages from 3 on: item 1 and low, or item 2.
    cognitive = F.when(item == 0, 0).otherwise(F.when((item == 1) & ~low, 0).otherwise(item + 1 + low.cast("int")))
    parkinsonism = (signs >= SUBTHRESHOLD_SIGNS) | (medicated == 1)
    symptoms = (item >= 1) | parkinsonism | (rbd == 1) | (smell <= HYPOSMIA_PERCENTILE)
    motor_stage = F.when(motor.between(3, 13), F.when(parkinsonism, 3).when(~parkinsonism, 0)).otherwise(_at_least(motor, MOTOR_STAGES))
    other = _at_least(rest, NON_MOTOR_STAGES)
    other = F.when(other == 4, F.when(symptoms, 4).when(~symptoms, 0)).otherwise(other)
    domains = [cognitive, motor_stage, other]
    worst = F.greatest(*domains)
    complete = functools.reduce(lambda a, b: a & b, [x.isNotNull() for x in domains])
    functional = F.when(complete | (worst == 6), worst)
    early = F.when(symptoms, 2).when(~symptoms, 1)
    positive, dopamine = s == S_POSITIVE, d == D_POSITIVE
    number = F.when(positive & dopamine, F.when(functional >= 3, functional).when(functional.isNotNull(), early))
    number = number.when(positive & ~dopamine, early).when(~positive & ~dopamine & (g == G_SNCA), 0)
    nsd = F.when(positive | (g == G_SNCA), 1).when(~positive & (g.isNull() | (g != G_SNCA)), 0)
    visits = visits.withColumns({"nsd": nsd, "stage_number": number.cast("int")})
    visits = visits.withColumn("stage", F.concat(F.col("stage_number").cast("string"), F.when(F.col("stage_number").isin(1, 2), F.when(dopamine, "B").otherwise("A")).otherwise("")))
    return visits.drop(*[f"_{f}" for f in STAGE_FIELDS])


def preferred_run(df: DataFrame, subject: str, project: str, preferred, run_date: str) -> DataFrame:
    order = Window.partitionBy(subject).orderBy((quoted(project) == F.lit(preferred)).desc_nulls_last(), quoted(run_date).desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
