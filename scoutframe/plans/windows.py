"""Window queries (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from . import domain as D
from .registry import query

SEASON = ["entity", "season"]
CAREER = ["season", "week"]


def _prior_sql(c: str, names: str, prefix: str, frame: str, ready: str, part: str = "entity, season", order: str = "week") -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {frame})"
    parts = {
        "cumulative": f"coalesce(sum({c}) {over}, 0)",
        "avg": f"avg({c}) {over}",
        "median": f"quantile_cont({c}, 0.5) {over}",
        "min": f"min({c}) {over}",
        "max": f"max({c}) {over}",
        "sd": f"stddev_samp({c}) {over}",
        "cv": f"stddev_samp({c}) {over} / nullif(avg({c}) {over}, 0)",
    }
    guard = f"count(*) {over} {ready}"
    return ", ".join(f"CASE WHEN {guard} THEN {parts[n]} END AS {prefix}{n}_{c}" for n in names.split())


_ALL = "cumulative avg median min max sd cv"
_WHOLE = ("UNBOUNDED PRECEDING AND 1 PRECEDING", "> 0")
_LAST3 = ("3 PRECEDING AND 1 PRECEDING", "= 3")


@query(
    "w1_expanding_prior_stats",
    f"SELECT entity, season, week, {_prior_sql('yards', _ALL, '', *_WHOLE)}, {_prior_sql('air', _ALL, '', *_WHOLE)} FROM panel",
    "panel",
    " ".join(f"{n}_{c}" for c in ("yards", "air") for n in _ALL.split()),
)
def w1(spark, d):
    df = W.prior_stats(D.panel(spark, d), SEASON, ["week"], ["yards", "air"])
    return df.select("entity", "season", "week", *[f"{n}_{c}" for c in ("yards", "air") for n in _ALL.split()])


@query(
    "w2_last3_prior_stats",
    f"SELECT entity, season, week, {_prior_sql('yards', _ALL, 'last3_', *_LAST3, part='entity', order='season, week')}, "
    f"{_prior_sql('air', _ALL, 'last3_', *_LAST3, part='entity', order='season, week')} FROM panel",
    "panel",
    " ".join(f"last3_{n}_{c}" for c in ("yards", "air") for n in _ALL.split()),
)
def w2(spark, d):
    df = W.prior_stats(D.panel(spark, d), ["entity"], CAREER, ["yards", "air"])
    return df.select("entity", "season", "week", *[f"last3_{n}_{c}" for c in ("yards", "air") for n in _ALL.split()])


@query(
    "w1_expanding_sums_only",
    "SELECT team, season, week, CASE WHEN count(*) OVER w > 0 THEN coalesce(sum(yards) OVER w, 0) END AS cumulative_yards, "
    "CASE WHEN count(*) OVER l = 3 THEN coalesce(sum(yards) OVER l, 0) END AS last3_cumulative_yards FROM teams "
    "WINDOW w AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "l AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "teams",
    "cumulative_yards last3_cumulative_yards",
)
def w1_sums(spark, d):
    df = W.prior_stats(D.teams(spark, d), ["team", "season"], ["week"], ["yards"], sums_only=True)
    return df.select("team", "season", "week", "cumulative_yards", "last3_cumulative_yards")


@query(
    "w3_trailing_51_and_30",
    "SELECT team, season, week, avg(yards) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 51 PRECEDING AND 1 PRECEDING) AS avg_last51, "
    "avg(yards) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS avg_last30 FROM teams",
    "teams",
    "avg_last51 avg_last30",
)
def w3(spark, d):
    return D.teams(spark, d).select(
        "team", "season", "week",
        F.avg("yards").over(W.prior(["team"], CAREER, 51)).alias("avg_last51"),
        F.avg("yards").over(W.prior(["team"], CAREER, 30)).alias("avg_last30"),
    )


@query(
    "w4_lags",
    "SELECT entity, season, week, lag(yards, 1) OVER w AS yards_lag1, lag(yards, 2) OVER w AS yards_lag2, lag(yards, 3) OVER w AS yards_lag3, "
    "lag(touches, 1) OVER w AS touches_lag1, lag(touches, 2) OVER w AS touches_lag2, lag(touches, 3) OVER w AS touches_lag3, "
    "lag(urgent > 0, 1) OVER w AS had_urgent_lag1 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY season, week)",
    "panel",
)
def w4(spark, d):
    df = D.panel(spark, d).withColumn("had_urgent", F.col("urgent") > 0)
    out = W.lags(df, ["entity"], CAREER, ["yards", "touches", "had_urgent"])
    return out.select(
        "entity", "season", "week", *[f"{c}_lag{n}" for c in ("yards", "touches") for n in (1, 2, 3)], "had_urgent_lag1"
    )


@query(
    "w5_prior_counts",
    "SELECT entity, season, week, row_number() OVER (PARTITION BY entity ORDER BY season, week) - 1 AS games_played, "
    "row_number() OVER (PARTITION BY entity, season ORDER BY week) - 1 AS games_played_this_season, "
    "row_number() OVER (PARTITION BY entity, team ORDER BY season, week) - 1 AS games_with_team FROM panel",
    "panel",
)
def w5(spark, d):
    return D.panel(spark, d).select(
        "entity", "season", "week",
        W.ordinal(["entity"], CAREER).alias("games_played"),
        W.ordinal(SEASON, ["week"]).alias("games_played_this_season"),
        W.ordinal(["entity", "team"], CAREER).alias("games_with_team"),
    )


@query(
    "w6_run_length",
    "SELECT entity, season, week, team, row_number() OVER (PARTITION BY entity, island ORDER BY season, week) AS weeks_on_team FROM ("
    "SELECT *, sum(started) OVER (PARTITION BY entity ORDER BY season, week ROWS UNBOUNDED PRECEDING) AS island FROM ("
    "SELECT *, CASE WHEN team IS NOT DISTINCT FROM lag(team) OVER (PARTITION BY entity ORDER BY season, week) THEN 0 ELSE 1 END AS started FROM panel))",
    "panel",
)
def w6(spark, d):
    df = W.run_length(D.panel(spark, d), ["entity"], CAREER, "team", "weeks_on_team")
    return df.select("entity", "season", "week", "team", "weeks_on_team")


@query(
    "w7_change_flags",
    "SELECT entity, season, week, team, coalesce(lag(team) OVER (PARTITION BY entity, season ORDER BY week) <> team, FALSE) AS arrived_mid_season, "
    "season = min(season) OVER (PARTITION BY entity, team) AS first_season_with_team FROM panel",
    "panel",
)
def w7(spark, d):
    df = W.change_flags(D.panel(spark, d), "entity", "season", ["week"], "team")
    return df.select("entity", "season", "week", "team", "arrived_mid_season", "first_season_with_team")


@query(
    "w8_latest_per_key",
    "SELECT user_id, event_type, event_id, american_odds FROM lines QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY run_time DESC, event_id DESC) = 1",
    "lines",
)
def w8(spark, d):
    df = D.lines(spark, d).select("user_id", "event_type", "event_id", "american_odds", "run_time")
    return W.latest_per_key(df, ["user_id", "event_type"], ["run_time", "event_id"]).drop("run_time")


@query(
    "w9_groups_seen",
    "SELECT entity, season, week, team, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY season, week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS teams_so_far "
    "FROM (SELECT *, row_number() OVER (PARTITION BY entity, team ORDER BY season, week) AS rn FROM panel)",
    "panel",
)
def w9(spark, d):
    df = W.groups_seen(D.panel(spark, d), "entity", CAREER, "team", "teams_so_far")
    return df.select("entity", "season", "week", "team", "teams_so_far")


@query(
    "w10_fill_down",
    "SELECT entity, season, week, last_value(air IGNORE NULLS) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS air_filled FROM panel",
    "panel",
    "air_filled",
)
def w10(spark, d):
    return D.panel(spark, d).select(
        "entity", "season", "week", W.fill_down("air", ["entity"], CAREER).alias("air_filled")
    )


@query(
    "w11_share_and_delta",
    "SELECT entity, season, week, share, share - avg(share) OVER (PARTITION BY entity ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS share_delta "
    "FROM (SELECT *, yards / nullif(sum(yards) OVER (PARTITION BY season, week, team), 0) AS share FROM panel)",
    "panel",
    "share share_delta",
    digits=10,
)
def w11(spark, d):
    df = W.share_of_group(D.panel(spark, d), ["season", "week", "team"], "yards", "share")
    usual = F.avg("share").over(W.prior(["entity"], CAREER))
    return df.select("entity", "season", "week", "share", (F.col("share") - usual).alias("share_delta"))


def _matchup_sql(entity: str, weight: int, frame: str, name: str) -> str:
    return (
        f"(vs_avg * met + all_avg * {weight}) / (met + {weight}) / nullif(all_avg, 0) AS {name} FROM ("
        f"SELECT *, avg(yards) OVER (PARTITION BY {entity} ORDER BY season, week ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS all_avg, "
        f"avg(yards) OVER (PARTITION BY {entity}, opponent ORDER BY season, week ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS vs_avg, "
        f"count(*) OVER (PARTITION BY {entity}, opponent ORDER BY season, week ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS met FROM "
    )


@query(
    "w12_matchup_ratio_player",
    f"SELECT entity, season, week, opponent, {_matchup_sql('entity', 2, 'UNBOUNDED', 'matchup_ratio')} panel)",
    "panel",
    "matchup_ratio",
)
def w12_player(spark, d):
    df = W.matchup_ratio(D.panel(spark, d), ["entity"], "opponent", CAREER, "yards", 2, "matchup_ratio")
    return df.select("entity", "season", "week", "opponent", "matchup_ratio")


@query(
    "w12_matchup_ratio_team",
    f"SELECT team, season, week, opponent, {_matchup_sql('team', 4, '51', 'matchup_ratio')} teams)",
    "teams",
    "matchup_ratio",
)
def w12_team(spark, d):
    df = W.matchup_ratio(D.teams(spark, d), ["team"], "opponent", CAREER, "yards", 4, "matchup_ratio", last=51)
    return df.select("team", "season", "week", "opponent", "matchup_ratio")


@query(
    "w13_rank_of_totals",
    "SELECT season, team, total_yards, rank() OVER (PARTITION BY season ORDER BY total_yards DESC) AS yards_rank FROM "
    "(SELECT season, team, sum(yards) AS total_yards FROM teams GROUP BY season, team)",
    "teams",
    "total_yards",
)
def w13(spark, d):
    totals = D.teams(spark, d).groupBy("season", "team").agg(F.sum("yards").alias("total_yards"))
    w = W.Window.partitionBy("season").orderBy(F.desc("total_yards"))
    return totals.withColumn("yards_rank", F.rank().over(w))


_LADDER_SQL = (
    "SELECT season, week, label, root, number, p, lag(p) OVER (PARTITION BY season, week, label, root ORDER BY number) AS previous_probability FROM ("
    "SELECT season, week, label, regexp_replace(response_var, '_(minus)?[0-9]+([.][0-9]+)?$', '') AS root, "
    "CAST(regexp_extract(replace(response_var, 'minus', '-'), '-?[0-9]+([.][0-9]+)?', 0) AS DOUBLE) AS number, max(p) AS p "
    "FROM bets WHERE response_var NOT IN ('anytime_td_scorer', 'team_win') GROUP BY ALL)"
)


@query(
    "w14_ladder_check",
    f"SELECT *, coalesce(p > previous_probability + 0.05, FALSE) AS violates FROM ({_LADDER_SQL})",
    "bets",
    "number p previous_probability",
)
def w14(spark, d):
    rungs = ladder_rungs(D.bets(spark, d))
    return W.ladder_violations(rungs, ["season", "week", "label", "root"], "number", "p", 0.05)


def ladder_rungs(bets):
    """One row per label, week and rung."""
    from ..functions.scalars import ladder_number, ladder_root

    return (
        bets.where(~F.col("response_var").isin("anytime_td_scorer", "team_win"))
        .groupBy("season", "week", "label", ladder_root("response_var").alias("root"),
                 ladder_number("response_var").alias("number"))
        .agg(F.max("p").alias("p"))
    )


@query(
    "w15_top_n_per_group",
    "SELECT season, week, bet_id, odds, rn AS rank_in_week FROM (SELECT *, row_number() OVER (PARTITION BY season, week ORDER BY p DESC, bet_id) AS rn FROM bets) WHERE rn <= 3",
    "bets",
    "odds",
)
def w15(spark, d):
    df = D.bets(spark, d).select("season", "week", "bet_id", "odds", "p")
    return W.top_n(df, ["season", "week"], [F.desc("p"), "bet_id"], 3, rank="rank_in_week").drop("p")


@query(
    "w16_week_bounds",
    "SELECT team, season, week, CAST(week_end AS VARCHAR) AS week_end, CAST(coalesce(lag(week_end) OVER (PARTITION BY team, season ORDER BY week) + INTERVAL 1 SECOND, "
    "make_timestamp(season, 1, 1, 0, 0, 0)) AS VARCHAR) AS week_start FROM ("
    "SELECT team, CAST(season AS BIGINT) AS season, week, max(o_orderdate) AS week_end FROM ("
    "SELECT CAST(c_nationkey AS BIGINT) AS team, year(o_orderdate) AS season, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS week, o_orderdate "
    "FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY ALL)",
)
def w16(spark, d):
    bounds = week_bounds(spark, d)
    return bounds.select("team", "season", "week", F.col("week_end").cast("string"), F.col("week_start").cast("string"))


def week_bounds(spark, d):
    homes = D.table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("team")
    )
    ends = (
        D.table(spark, d, "orders").select("o_custkey", *D.period_columns("o_orderdate"), "o_orderdate")
        .join(homes, "o_custkey")
        .groupBy("team", "season", "week")
        .agg(F.max("o_orderdate").alias("week_end"))
    )
    return W.active_windows(
        ends, ["team", "season"], "week", "week_end",
        F.expr("CAST(make_date(CAST(season AS int), 1, 1) AS timestamp_ntz)"),
    )


@query(
    "w17_best_within_tolerance",
    "SELECT season, team, yards_per_play FROM (SELECT *, max(yards_per_play) OVER (PARTITION BY season) AS best, count(*) OVER (PARTITION BY season) AS n FROM "
    "(SELECT season, team, sum(yards) / sum(plays) AS yards_per_play FROM teams GROUP BY season, team)) WHERE n = 1 OR yards_per_play >= best - 10",
    "teams",
    "yards_per_play",
)
def w17(spark, d):
    df = D.teams(spark, d).groupBy("season", "team").agg((F.sum("yards") / F.sum("plays")).alias("yards_per_play"))
    return W.within_best(df, ["season"], "yards_per_play", 10.0, higher=True)
