"""Prior-history windows on hand-made panels."""

import pytest
from pyspark.sql import functions as F

from scoutframe.operators import windows as W


@pytest.fixture(scope="module")
def panel(spark):
    # week 4 is a bye, week 3 has no value, the team changes twice
    rows = [("a", 1, 1, 10.0, "X"), ("a", 1, 2, 20.0, "X"), ("a", 1, 3, None, "Y"), ("a", 1, 5, 40.0, "Y"), ("a", 1, 6, 50.0, "X"), ("b", 1, 1, None, "X"), ("b", 1, 2, 7.0, "X")]
    return spark.createDataFrame(rows, "entity string, season int, week int, v double, team string")


def by_key(df, name):
    return {(r["entity"], r["week"]): r[name] for r in df.collect()}


def test_expanding_and_last3(panel):
    out = W.prior_stats(panel, ["entity", "season"], ["week"], ["v"])
    total, mean, last = by_key(out, "cumulative_v"), by_key(out, "avg_v"), by_key(out, "last3_cumulative_v")
    assert total[("a", 1)] is None and mean[("a", 1)] is None
    assert total[("a", 5)] == 30.0 and mean[("a", 5)] == 15.0
    assert total[("b", 2)] == 0.0 and mean[("b", 2)] is None  # only NULLs before
    assert last[("a", 3)] is None and last[("a", 5)] == 30.0  # three rows, not three weeks
    assert last[("a", 6)] == 60.0
    assert by_key(out, "median_v")[("a", 6)] == 20.0


def test_no_leak(panel):
    base = W.prior_stats(panel, ["entity", "season"], ["week"], ["v"])
    changed = W.prior_stats(panel.withColumn("v", F.when(F.col("week") >= 5, 999.0).otherwise(F.col("v"))), ["entity", "season"], ["week"], ["v"])
    for name in ("cumulative_v", "last3_sd_v", "median_v"):
        a, b = by_key(base, name), by_key(changed, name)
        assert all(a[k] == b[k] for k in a if k[1] <= 5)


def test_runs_changes_groups(panel):
    run = by_key(W.run_length(panel, ["entity"], ["season", "week"], "team", "n"), "n")
    assert [run[("a", w)] for w in (1, 2, 3, 5, 6)] == [1, 2, 1, 2, 1]
    seen = by_key(W.groups_seen(panel, "entity", ["season", "week"], "team", "n"), "n")
    assert [seen[("a", w)] for w in (1, 2, 3, 5, 6)] == [1, 1, 2, 2, 2]
    flags = by_key(W.change_flags(panel, "entity", "season", ["week"], "team"), "arrived_mid_season")
    assert [flags[("a", w)] for w in (1, 2, 3, 5, 6)] == [False, False, True, False, True]


def test_first_meeting_has_no_ratio(spark):
    rows = [("a", 1, 1, "o", 10.0), ("a", 1, 2, "p", 20.0), ("a", 1, 3, "o", 30.0)]
    df = spark.createDataFrame(rows, "entity string, season int, week int, opp string, v double")
    out = by_key(W.matchup_ratio(df, ["entity"], "opp", ["season", "week"], "v", 2, "r"), "r")
    assert out[("a", 1)] is None and out[("a", 2)] is None
    assert out[("a", 3)] == pytest.approx(((10 * 1 + 15 * 2) / 3) / 15)


def test_latest_is_an_aggregate_with_map_side_combine(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    out = W.latest_per_key(df, ["k"], ["t"])
    assert {(r["k"], r["v"]) for r in out.collect()} == {(0, 198), (1, 194), (2, 196)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max_by" in plan


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = W.top_n(df, ["k"], [F.desc("t")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_lone_candidate_survives_a_missing_metric(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 5.0)], "k string, m double")
    assert {(r["k"], r["m"]) for r in W.within_best(df, ["k"], "m", 1.0).collect()} == {("a", None), ("b", 1.0)}
