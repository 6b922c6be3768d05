"""Contributor families, workload fallbacks, press conferences and missing levels on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from scoutframe.functions import scalars as C
from scoutframe.models import prepare as Q
from scoutframe.operators import aggregates as A
from scoutframe.operators import contributors as K
from scoutframe.operators import features as X

SCHEMA = "family string, entity int, season int, week int, team int, metric double, group_metric double, share double"


def career(family, entity, level, share=None, seasons=(2000, 2001, 2002), weeks=3):
    return [(family, entity, s, w, 1, float(level), 10.0, share) for s in seasons for w in range(1, weeks + 1)]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [r for e in range(10) for r in career("passing", e, 100 * e)]
    rows += [r for e in range(10) for r in career("rushing", e, 100 * (9 - e), share=0.39 if e == 1 else 0.4)]
    rows += career("receiving", 50, 1000, share=0.9, seasons=(2001, 2002))  # no third season, so no metric
    return {(r["entity"], r["season"], r["week"]): r for r in K.contributor_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_each_family_has_its_own_limits(verdicts):
    # results never differ, so no test can be made and the 80th percentile decides
    assert [e for e in range(10) if verdicts[e, 2002, 2]["passing"]] == [8, 9]
    assert [e for e in range(10) if verdicts[e, 2002, 2]["rushing"]] == [0]  # 1 has too small a share


def test_only_seasons_with_history_come_back(verdicts):
    assert {season for _, season, _ in verdicts} == {2002}


def test_no_metric_and_other_families_are_false(verdicts):
    assert not any(verdicts[50, 2002, 1][f.name] for f in K.FAMILIES)
    assert not verdicts[9, 2002, 2]["secondary"]


def test_side_follows_the_family(spark):
    """Group results fall while the entity plays: evidence for 'greater' without it, none for 'less'."""
    rows = []
    for family in ("passing", "secondary"):
        for season in range(2000, 2006):
            rows += [(family, 1, season, w, 1, 5.0, 100.0 + season if w == 1 else 10.0 + w + season / 10, 1.0) for w in range(1, 5)]
    got = K.contributor_evidence(spark.createDataFrame(rows, SCHEMA)).where("season = 2005 AND week = 4").select("family", "p_play").collect()
    p = dict(got)
    assert p["passing"] < 0.01 and p["secondary"] > 0.99


def test_empty_rows_give_no_verdicts(spark):
    assert K.contributor_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_known_names_what_it_took(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "a double, b double")
    value, taken = X.first_known({"own": "a", "last": "b"})
    assert [tuple(r) for r in df.select(value, taken).collect()] == [(1.0, "own"), (2.0, "last"), (None, None)]


def test_press_conference_titles(spark):
    titles = ["PRESS room", "Address to the Media", "address", "media day", "Coach talks", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(C.is_press_conference("t")).collect()] == [True, True, False, False, False, None]


def test_conference_text_is_one_value_in_order(spark):
    df = spark.createDataFrame(
        [(1, 2, "Press b", None), (1, 1, "Coach press a", "x"), (1, 3, "other", "y"), (2, 1, "other", "z")], "k int, n int, title string, body string"
    )
    got = A.conference_text(df, ["k"], "title", ["body"], ["n"]).collect()
    assert [tuple(r) for r in got] == [(1, "Coach press a x\n\nPress b", True, 2)]


def test_missing_is_a_level_and_unseen_is_none(spark):
    df = spark.createDataFrame([("a",), (None,), ("new",)], "c string")
    got = Q.one_hot(Q.named_missing(df, ["c"]), "c", ["a", Q.MISSING])
    assert [tuple(r) for r in got.select("c_a", "c_missing").collect()] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
