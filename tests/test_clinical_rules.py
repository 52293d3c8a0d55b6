"""Doses and assay rules by cases worked out by hand from the published script and tables."""

import pytest

from cohortloom.operators import clinical


def at(spark, rows, **kw):
    meds = spark.createDataFrame(rows, "PATNO int, LEDTRT string, STARTDT string, STOPDT string, LEDD string, S double, D double, Q double")
    return {(r.subject, str(r.t)): (r.levodopa, pytest.approx(r.total)) for r in clinical.total_ledd_at(meds, **kw).collect()}


def test_doses_under_a_factor(spark):
    rows = [(1, "Sinemet", "2020-01-01", None, "100", None, None, None), (1, "Comtan", "2020-01-01", None, "(150 + LD) x 0.33", None, None, None)]
    assert at(spark, rows) == {(1, "2020-01-01"): (100.0, 182.5)}
    rows = [
        (2, "SINEMET", "2020-01-01", "2020-03-01", "300", None, None, None),
        (2, "entacapone", "2020-02-01", None, "LD x 0.33", None, None, None),
        (2, "opicapone", "2020-02-01", None, "(100+LD) X .5", None, None, None),
        (2, "pramipexole", "2020-02-01", "2020-01-01", "999", None, None, None),  # stops before it starts
        (2, "amantadine", "2020-02-10", None, "no number", None, None, None),
        (3, "other", "2020-01-01", None, None, None, None, None),
    ]
    got = at(spark, rows)
    assert got[2, "2020-01-01"] == (300.0, 300.0) and got[2, "2020-02-01"] == (300.0, 300 + 99 + 0.5 * 400)
    assert got[2, "2020-02-10"] == got[2, "2020-02-01"] and got[2, "2020-04-01"] == (0.0, 50.0) and got[3, "2020-01-01"] == (0.0, 0.0)
    assert len(got) == 5  # a month after the stop before the start is 2020-02-01 as well


def test_amounts_stand_in_for_doses_without_a_number(spark):
    rows = [(1, "MADOPAR", "2020-01-01", None, "as needed", 50.0, 2.0, 3.0), (1, "other", "2020-01-01", None, "as needed", 50.0, 2.0, 3.0)]
    assert at(spark, rows, amounts=("S", "D", "Q")) == {(1, "2020-01-01"): (300.0, 300.0)}
    assert at(spark, rows) == {(1, "2020-01-01"): (0.0, 0.0)}


CASES = [
    ((50_000, 50_000, 100), "Inconclusive", None, "Inconclusive"),
    ((6_000, 6_000, 6_000), "Positive", "Type 2", "Positive"),
    ((50_000, 100, 100), "Negative", "NA", "Negative"),
    ((4_000, 4_000, 4_000), "Positive", "Type 2", "Negative"),
    ((45_000, 45_000, 45_000), "Positive", "Type 1", "Positive"),
    ((45_000, 45_000, 44_999), "Positive", "Undetermined", "Positive"),
    ((3_000, 2_999, 3_000), "Positive", "Type 2", "Negative"),
    ((45_000, 3_000, 2_999), "Inconclusive", None, "Negative"),
    ((5_000, 5_000, 4_999), "Positive", "Type 2", "Inconclusive"),
    ((0, 0, 3_000), "Negative", "NA", "Negative"),
    ((50_000, None, 50_000), None, None, None),
]


@pytest.mark.parametrize("project", [237, 155])
def test_assay_rules(spark, project):
    df = spark.createDataFrame([(k, *map(lambda v: None if v is None else float(v), x[0])) for k, x in enumerate(CASES)], "k int, a double, b double, c double")
    got = {r.k: (r.status, r.assay_type) for r in clinical.assay_status(df, ["a", "b", "c"], project).collect()}
    want = {k: (x[1], x[2]) if project == 237 else (x[3], None) for k, x in enumerate(CASES)}
    assert got == want
    assert {r.status for r in clinical.assay_status(df, ["a", "b", "c"], 7).collect()} == {None}


VISIT = "subject int, visit int, s int, d int, g int, cognition int, moca int, signs int, motor int, non_motor int, medicated int, rbd int, smell int"


@pytest.mark.parametrize(
    "visit, stage",
    [
        ((0, 0, 3, 0, 30, 0, 0, 0, 0, 0, 50), "0"),
        ((1, 0, 0, 0, 30, 0, 0, 0, 0, 0, 50), "1A"),
        ((1, 1, 0, 0, 30, 0, 2, 0, 0, 0, 50), "1B"),
        ((1, 0, 0, 0, 30, 5, 0, 0, 0, 0, 50), "2A"),
        ((1, 1, 0, 1, 25, 0, 0, 0, 0, 0, 50), "2B"),
        ((1, 1, 0, 0, 30, 0, 0, 0, 0, 0, 15), "2B"),
        ((1, 1, 0, 1, 24, 0, 0, 0, 0, 0, 50), "3"),
        ((1, 1, 0, 0, 30, 0, 3, 0, 1, 0, 50), "3"),
        ((1, 1, 0, 0, 30, 4, 13, 0, 0, 0, 50), "1B"),  # a motor sum without signs or medication
        ((1, 1, 0, 2, 24, 0, 0, 0, 0, 0, 50), "4"),
        ((1, 1, 0, 0, 30, 0, 0, 13, 0, 1, 50), "4"),
        ((1, 1, 0, 0, 30, 0, 0, 24, 0, 0, 50), "1B"),  # no sign of stage 2
        ((1, 1, 0, 4, 25, 0, 0, 0, 0, 0, 50), "5"),
        ((1, 1, 0, 0, 30, 0, 39, 0, 0, 0, 50), "5"),
        ((1, 1, 0, 4, 24, 0, 0, 0, 0, 0, 50), "6"),
        ((1, 1, 0, None, None, 0, 40, None, 0, 0, 50), "6"),  # one domain is enough there
        ((1, 1, 0, None, None, 0, 27, 0, 0, 0, 50), None),
        ((1, None, 0, 0, 30, 0, 0, 0, 0, 0, 50), None),
        ((2, 1, 0, 4, 20, 9, 50, 40, 1, 1, 1), None),
        ((0, 1, 3, 0, 30, 0, 0, 0, 0, 0, 50), None),
    ],
)
def test_stages(spark, visit, stage):
    df = spark.createDataFrame([(1, 1, *visit)], VISIT)
    assert clinical.synuclein_stage(df, "subject", "visit", {f: f for f in clinical.STAGE_FIELDS}).first().stage == stage


def test_stage_carries_forward(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 0, 2, 26, 0, 0, 0, 0, 0, 50), (1, 2, None, None, None, None, 20, None, None, None, None, None, None), (2, 2, None, None, None, None, 20, None, None, None, None, None, None)], VISIT)
    got = {(r.subject, r.visit): (r.nsd, r.stage, r.stage_number) for r in clinical.synuclein_stage(df, "subject", "visit", {f: f for f in clinical.STAGE_FIELDS}).collect()}
    assert got == {(1, 1): (1, "3", 3), (1, 2): (1, "4", 4), (2, 2): (None, None, None)}
