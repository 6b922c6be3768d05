"""The weekly flow end to end."""

import pytest
from pyspark.sql import functions as F

from scoutframe import api
from scoutframe.plans.catalog import QUERIES


def test_stakes_sum_to_the_bank_below_the_cap(spark, folder):
    out = QUERIES["e3_bets_to_stakes"](spark, folder)
    rows = out.groupBy("season", "week").agg(F.sum("bet_amount").alias("s"), F.max("portfolio_sd").alias("sd"), F.count_distinct("portfolio_id").alias("k"), F.count("*").alias("n")).collect()
    assert len(rows) > 50
    assert all(r["s"] == pytest.approx(50.0, abs=1e-3) and r["sd"] < 3.0 and r["k"] == 1 and r["n"] <= 10 for r in rows)


def test_correlations_of_the_season_before(spark):
    table = spark.createDataFrame(
        [(2024, "2025-01-01", "WR|TE", 0.5), (2024, "2025-02-01", "WR|TE", 0.6), (2023, "2025-03-01", "WR", 0.7)],
        "max_year int, created_at string, position1 string, cor double",
    ).selectExpr("*", "'a' AS var1", "'QB' AS position2", "'b' AS var2", "'same_team' AS relation")
    got = {(r["position1"], r["cor"]) for r in api.correlations_for_season(table, 2025).collect()}
    assert got == {("WR", 0.6), ("TE", 0.6)}
    with pytest.raises(ValueError):
        api.correlations_for_season(table, 2020)


def test_portfolio_needs_its_columns(spark):
    with pytest.raises(ValueError):
        api.portfolios(spark.createDataFrame([(1,)], "season int"), None, 50.0, 1.0)
