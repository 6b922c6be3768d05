"""Cards of players and venues, and portfolios over every bet, on hand-made rows."""

import math

from scoutframe.operators import ledger as L
from scoutframe.operators import portfolio as R
from scoutframe.operators import schema as P

PLAYER = "entity int, position string, season int, week int, opponent int, value double"


def test_player_card_knows_only_what_was_before(spark):
    rows = spark.createDataFrame([
        (1, "QB", 2000, 1, 7, 10.0), (1, "QB", 2000, 2, 8, None), (1, "QB", 2000, 3, 7, 30.0), (1, "QB", 2001, 1, 7, 50.0), (2, "QB", 2000, 1, 8, 5.0),
    ], PLAYER)
    got = {(r["entity"], r["season"], r["week"]): r for r in L.player_cards(rows, "value").collect()}
    first, last = got[1, 2000, 1], got[1, 2001, 1]
    assert (first["games_against"], first["avg_against"], first["last_against"], first["season_avg"], first["last3_values"]) == (0, None, None, None, "")
    assert (last["games_against"], last["avg_against"], last["last_against"]) == (2, 20.0, "2000 W3: 30")
    assert (last["season_avg"], last["season_best"], last["last_season_avg"], last["last_season_games"]) == (None, None, 20.0, 2)
    assert last["last3_values"] == "10, 30"
    assert last["opponent_rank"] == 2  # 7 allowed 40 last season, 8 only 5
    assert got[1, 2000, 3]["last_against"] == "2000 W1: 10" and got[1, 2000, 3]["season_best"] == 10.0


def test_venue_rates_by_ground(spark):
    rows = spark.createDataFrame([
        (2000, 1, 1, 2, 3, 0, "home"), (2000, 2, 1, 2, 0, 3, "away"), (2000, 3, 1, 2, 3, 0, "neutral"), (2000, 4, 1, 2, None, None, "neutral"), (2001, 1, 1, 2, 3, 0, "home"),
    ], "season int, week int, team int, opponent int, team_score int, opponent_score int, venue string")
    got = {(r["season"], r["week"]): r for r in L.venue_win_rates(rows).collect()}
    assert got[2000, 1]["season_home_win_rate"] is None and got[2000, 1]["last_season_home_win_rate"] is None
    assert (got[2000, 4]["season_home_win_rate"], got[2000, 4]["season_away_win_rate"], got[2000, 4]["season_neutral_win_rate"]) == (1.0, 0.0, 1.0)
    assert (got[2001, 1]["last_season_neutral_win_rate"], got[2001, 1]["last_season_away_win_rate"]) == (1.0, 0.0)


def test_tilted_weights_take_every_bet_of_worth(spark):
    bets = spark.createDataFrame([(1, "a", 2.0, 4.0), (1, "b", 1.0, 1.0), (1, "c", -1.0, 1.0), (1, "d", 1.0, 0.0), (1, "e", None, 1.0)], "week int, bet_id string, ev double, risk_score double")
    got = {(r["portfolio_id"], r["bet_id"]): r["weight"] for r in R.tilted_weights(bets, ["week"], [0.0, 1.0]).collect()}
    want = {(0, "a"): 2 / 3, (0, "b"): 1 / 3, (1, "a"): 1 / 3, (1, "b"): 2 / 3}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert R.tilted_weights(bets.limit(0), ["week"], [0.0]).count() == 0


def test_verdicts_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (2.0, None, 1.0), (3.0, None, 1.0)], "a double, none double, flag double")
    got = {r["name"]: (r["present"], r["median"], r["verdict"]) for r in P.informative_columns(df, ["a", "none", "flag"], 0.5).collect()}
    assert got == {"a": (3, 2.0, "keep"), "none": (0, None, "drop"), "flag": (3, 1.0, "zero_one")}


def test_tilts_become_rows_after_the_totals_are_known(spark):
    from pyspark.sql import functions as F

    from scoutframe.operators import portfolio as R

    bets = spark.range(40).select(F.lit(1).alias("week"), F.col("id").alias("bet_id"), (F.col("id") + 1.0).alias("ev"), F.lit(2.0).alias("risk_score"))
    out = R.tilted_weights(bets, ["week"], [0.0, 0.5, 1.0])
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert depth("Generate") < depth("Join")  # one row per bet meets the totals, not one per bet and tilt
    assert sum(line.count("Generate") for line in lines) == 1
    sums = {r["portfolio_id"]: r["s"] for r in out.groupBy("portfolio_id").agg(F.round(F.sum("weight"), 9).alias("s")).collect()}
    assert sums == {0: 1.0, 1: 1.0, 2: 1.0}
