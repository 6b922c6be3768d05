"""Ledger summaries, pick planning, boards and detail cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from .aggregates import ordered_text
from .windows import prior


def ledger_payout(result: str, amount: str, odds: str) -> Column:
    """A win pays stake and profit, a refund the stake, an open bet nothing yet."""
    r = F.col(result)
    return (
        F.when(r == "Win", C.payout(amount, odds)).when(r == "Refund", F.col(amount)).when(r.isNull(), F.lit(None).cast("double")).otherwise(0.0)
    )


def ledger_summary(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Settled bets without refunds: counts, share won, money in and out."""
    settled = ledger.where("result IS NOT NULL AND result <> 'Refund'").withColumn("_paid", ledger_payout("result", "amount", "odds"))
    return settled.groupBy(*by).agg(
        F.count("*").alias("bets"), F.count_if(F.col("result") == "Win").alias("wins"),
        F.avg((F.col("result") == "Win").cast("double")).alias("win_share"),
        F.sum("amount").alias("spent"), F.sum("_paid").alias("payout"),
        F.try_divide(F.sum("_paid") - F.sum("amount"), F.sum("amount")).alias("total_return"),
    )


def unsettled(ledger: DataFrame, now: Column, start: str, hours: int = 3) -> DataFrame:
    return ledger.where(F.col("result").isNull() & (F.col(start) < now - F.expr(f"INTERVAL {hours} HOURS")))


def pick_options(picks: DataFrame, period: Sequence[str], pick: str, detail: str) -> DataFrame:
    """How many safe picks each period offers and which; at most one per team."""
    return picks.groupBy(*period).agg(
        F.count("*").alias("safe_picks"), ordered_text([pick], pick, ",").alias("picks"), ordered_text([pick], detail, "; ").alias("details")
    )


def picks_per_team(picks: DataFrame, teams: DataFrame, team: str, pick: str, week: str) -> DataFrame:
    """Weeks in which each team is a safe pick; teams without any are kept with 0."""
    named = picks.withColumn("_w", F.concat(F.lit("Week "), F.col(week)))
    per_team = named.groupBy(F.col(pick).alias(team)).agg(
        F.count_distinct(week).alias("num_weeks"), ordered_text([week], "_w", "; ").alias("options")
    )
    return teams.join(per_team, team, "left").withColumns({
        "num_weeks": F.coalesce("num_weeks", F.lit(0)), "options": F.coalesce("options", F.lit(""))
    })


def detail_cards(team_rows: DataFrame, values: str) -> DataFrame:
    """Facts about each game of every season known before it was played.

    ``team_rows`` has one row per team and game: season, week, team, opponent,
    team_score, opponent_score, venue and ``values``.
    """
    order = ["season", "week"]
    won = (F.col("team_score") > F.col("opponent_score")).cast("int")
    met = prior(["team", "opponent"], order)
    last_met = Window.partitionBy("team", "opponent").orderBy(*order)
    form = prior(["team", "season"], order)
    recent = prior(["team"], order, 3)
    facts = team_rows.select(
        "season", "week", "team", "opponent", "venue",
        F.concat_ws("-", F.coalesce(F.sum(won).over(met), F.lit(0)), F.coalesce(F.sum(1 - won).over(met), F.lit(0))).alias("head_to_head"),
        F.lag(F.concat(F.col("season"), F.lit(" W"), F.col("week"), F.lit(": "), F.col("team_score"), F.lit("-"), F.col("opponent_score"))).over(last_met).alias("last_meeting"),
        F.avg(won.cast("double")).over(form).alias("season_win_rate"),
        F.avg(F.when(F.col("venue") == "home", won.cast("double"))).over(form).alias("season_home_win_rate"),
        F.concat_ws(", ", F.transform(F.collect_list(values).over(recent), lambda v: v.cast("bigint").cast("string"))).alias("last3_values"),
    )
    after = (F.col("season") + 1).alias("season")
    averages = team_rows.groupBy(after, "team").agg(F.avg(values).alias("last_season_avg"))
    # rank of what a team allowed; one row per team and season, so the window is as small as the league
    allowed = team_rows.groupBy(after, "opponent").agg(F.sum(values).alias("_allowed"))
    rank = F.rank().over(Window.partitionBy("season").orderBy("_allowed"))
    ranks = allowed.select("season", "opponent", rank.alias("opponent_defence_rank"))
    return facts.join(averages, ["season", "team"], "left").join(ranks, ["season", "opponent"], "left")


VENUES = ("home", "away", "neutral")


def venue_win_rates(team_rows: DataFrame) -> DataFrame:
    """Share of games won at home, away and on neutral ground, this season before the game and last season.

    ``team_rows`` has one row per team and game: season, week, team, opponent, team_score, opponent_score and venue. A rate
    without a game is NULL; a game without both scores is no game yet.
    """
    won = (F.col("team_score") > F.col("opponent_score")).cast("double")
    form = prior(["team", "season"], ["week"])
    now = [F.avg(F.when(F.col("venue") == v, won)).over(form).alias(f"season_{v}_win_rate") for v in VENUES]
    past = [F.avg(F.when(F.col("venue") == v, won)).alias(f"last_season_{v}_win_rate") for v in VENUES]
    last = team_rows.groupBy((F.col("season") + 1).alias("season"), "team").agg(*past)
    return team_rows.select("season", "week", "team", "opponent", "venue", *now).join(last, ["season", "team"], "left")


def player_cards(rows: DataFrame, value: str) -> DataFrame:
    """Facts about each player's game known before it: form, history against the opponent, and what the opponent allows.

    ``rows`` has one row per player and game: entity, position, season, week, opponent and ``value``, a whole number or NULL.
    Ranks are per season and position over the opponents' totals, least allowed first, so those windows are as small as the
    league. The last meeting is the last game against the opponent with a known value.
    """
    order = ["season", "week"]
    met, season, recent = prior(["entity", "opponent"], order), prior(["entity", "season"], ["week"]), prior(["entity"], order, 3)
    told = F.concat(F.col("season"), F.lit(" W"), F.col("week"), F.lit(": "), F.col(value).cast("bigint"))
    facts = rows.select(
        "entity", "position", "season", "week", "opponent", F.count(value).over(met).alias("games_against"), F.avg(value).over(met).alias("avg_against"),
        F.last(told, ignorenulls=True).over(met).alias("last_against"), F.avg(value).over(season).alias("season_avg"),
        F.max(value).over(season).alias("season_best"),
        F.concat_ws(", ", F.transform(F.collect_list(value).over(recent), lambda v: v.cast("bigint").cast("string"))).alias("last3_values"),
    )
    after = (F.col("season") + 1).alias("season")
    own = rows.groupBy(after, "entity").agg(F.avg(value).alias("last_season_avg"), F.count(value).alias("last_season_games"))
    allowed = rows.groupBy(after, "position", "opponent").agg(F.sum(value).alias("_allowed"))
    rank = F.rank().over(Window.partitionBy("season", "position").orderBy("_allowed"))
    ranks = allowed.where("_allowed IS NOT NULL").select("season", "position", "opponent", rank.alias("opponent_rank"))
    return facts.join(own, ["season", "entity"], "left").join(ranks, ["season", "position", "opponent"], "left")


def upcoming_board(schedule: DataFrame, spreads: DataFrame, wins: DataFrame, names: DataFrame, after: Column) -> DataFrame:
    """Future games with both names, both win probabilities and the spread."""
    future = schedule.where(after)
    keys = ["season", "week"]
    out = future
    for side in ("home", "away"):
        out = out.join(names.select(F.col("team").alias(side), F.col("name").alias(f"{side}_name")), side, "left")
        out = out.join(wins.select(*keys, F.col("team").alias(side), F.col("p").alias(f"{side}_probability")), [*keys, side], "left")
    return out.join(spreads.select(*keys, F.col("team").alias("home"), "spread"), [*keys, "home"], "left")


def weekly_sheet(open_bets: DataFrame, games: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open bets beside their game, with the bettors of each bet in one text.

    Bettors are made distinct first, so the text is as long as the circle of bettors.
    """
    named = games.withColumn("game_key", C.pair_key("home", "away")).select(*keys, "game_key", "game_id", "slot")
    lines = open_bets.withColumn("game_key", C.pair_key("team", "opponent")).select(*keys, "game_key", "label", "response_var", "bettor").distinct()
    listed = lines.groupBy(*keys, "game_key", "label", "response_var").agg(ordered_text(["bettor"], "bettor", ", ").alias("bettors"))
    return listed.join(named, [*keys, "game_key"], "left")
