"""Aggregate queries (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators.quantiles import exact_percentiles
from . import domain as D
from .registry import query

BIN_SQL = (
    "SELECT *, CASE WHEN bp < 1000 THEN bp - bp % 200 WHEN bp < 3000 THEN bp - (bp - 1000) % 500 ELSE bp - (bp - 3000) % 1000 END AS fl, "
    "CASE WHEN bp < 1000 THEN 200 WHEN bp < 3000 THEN 500 ELSE 1000 END AS wd FROM (SELECT *, CAST(round(p * 10000) AS BIGINT) AS bp FROM {src})"
)


def reliability_sql(src: str, by: str = "") -> str:
    return (
        f"SELECT {by} probability_range, probability_floor, probability_ceiling, pct_win, n, mean_prediction, "
        "CASE WHEN n < 10 THEN 'Insufficient Data' WHEN pct_win BETWEEN probability_floor AND probability_ceiling THEN 'Inside Target Range' "
        "WHEN abs(pct_win - probability_ceiling) < probability_floor * 0.1 OR abs(probability_floor - pct_win) < probability_floor * 0.1 THEN 'Near Target Range' ELSE 'Bad' END AS assessment "
        f"FROM (SELECT {by} (fl // 100) || '% to ' || ((fl + wd) // 100) || '%' AS probability_range, fl / CAST(10000.0 AS DOUBLE) AS probability_floor, (fl + wd) / CAST(10000.0 AS DOUBLE) AS probability_ceiling, "
        f"avg(CAST(bet_hit AS DOUBLE)) AS pct_win, count(*) AS n, avg(p) AS mean_prediction FROM ({BIN_SQL.format(src=src)}) GROUP BY ALL)"
    )


@query(
    "a1_play_drive_game_rollup",
    "SELECT game_id, posteam, count(*) AS drives, CAST(sum(CASE WHEN redzone THEN 1 ELSE 0 END) AS BIGINT) AS drives_in_redzone, "
    "CAST(sum(CASE WHEN td THEN 1 ELSE 0 END) AS BIGINT) AS touchdowns_in_redzone, CAST(sum(rz) AS BIGINT) AS redzone_plays, CAST(sum(rzp) AS BIGINT) AS redzone_receiving_plays FROM ("
    "SELECT game_id, posteam, drive, bool_or(yardline_100 < 20 AND play_type <> 'punt') AS redzone, bool_or(yardline_100 < 20 AND touchdown) AS td, "
    "count(*) FILTER (WHERE yardline_100 < 20) AS rz, count(*) FILTER (WHERE play_type = 'pass' AND yardline_100 < 20) AS rzp FROM plays GROUP BY ALL) GROUP BY ALL",
    "plays",
)
def a1(spark, d):
    near = F.col("yardline_100") < 20
    drives = D.plays(spark, d).groupBy("game_id", "posteam", "drive").agg(
        F.bool_or(near & (F.col("play_type") != "punt")).alias("redzone"),
        F.bool_or(near & F.col("touchdown")).alias("td"),
        F.count_if(near).alias("rz"),
        F.count_if(near & (F.col("play_type") == "pass")).alias("rzp"),
    )
    return drives.groupBy("game_id", "posteam").agg(
        F.count("*").alias("drives"),
        F.count_if("redzone").alias("drives_in_redzone"),
        F.count_if("td").alias("touchdowns_in_redzone"),
        F.sum("rz").alias("redzone_plays"),
        F.sum("rzp").alias("redzone_receiving_plays"),
    )


@query(
    "a2_conditional_counts",
    "SELECT game_id, posteam, count(DISTINCT play_id) AS num_plays, CAST(sum(rushers) AS BIGINT) AS total_rushers, CAST(sum(blitzers) AS BIGINT) AS total_blitzers, "
    "count(*) FILTER (WHERE play_type = 'pass' AND touchdown) AS pass_touchdowns, count(*) FILTER (WHERE down = 3 AND touchdown) AS third_converted, "
    "count(*) FILTER (WHERE down = 3 AND NOT touchdown) AS third_failed, count(*) FILTER (WHERE down = 3) AS third_attempted, "
    "count(*) FILTER (WHERE down = 4) AS fourth_attempted FROM plays GROUP BY ALL",
    "plays",
)
def a2(spark, d):
    third = F.col("down") == 3
    out = D.plays(spark, d).groupBy("game_id", "posteam").agg(
        F.count_distinct("play_id").alias("num_plays"),
        F.sum("rushers").alias("total_rushers"),
        F.sum("blitzers").alias("total_blitzers"),
        F.count_if((F.col("play_type") == "pass") & F.col("touchdown")).alias("pass_touchdowns"),
        F.count_if(third & F.col("touchdown")).alias("third_converted"),
        F.count_if(third & ~F.col("touchdown")).alias("third_failed"),
        F.count_if(F.col("down") == 4).alias("fourth_attempted"),
    )
    return out.withColumn("third_attempted", F.col("third_converted") + F.col("third_failed"))


@query(
    "a3_possession_minutes",
    "SELECT game_id, posteam, sum(m) AS possession_minutes FROM (SELECT game_id, posteam, drive, max(CAST(split_part(possession, ':', 1) AS DOUBLE) + CAST(split_part(possession, ':', 2) AS DOUBLE) / 60.0) AS m FROM plays GROUP BY ALL) GROUP BY ALL",
    "plays",
    "possession_minutes",
    digits=9,
)
def a3(spark, d):
    per_drive = D.plays(spark, d).groupBy("game_id", "posteam", "drive").agg(
        F.max(A.minutes_from_clock("possession")).alias("m")
    )
    return per_drive.groupBy("game_id", "posteam").agg(F.sum("m").alias("possession_minutes"))


_SUMMARY = ["sum", "avg", "median", "max", "min", "sd", "cv"]


def _summary_sql(c: str) -> str:
    return (
        f"sum({c}) AS sum_{c}, avg({c}) AS avg_{c}, quantile_cont({c}, 0.5) AS median_{c}, max({c}) AS max_{c}, min({c}) AS min_{c}, "
        f"stddev_samp({c}) AS sd_{c}, stddev_samp({c}) / nullif(avg({c}), 0) AS cv_{c}"
    )


@query(
    "a4_seasonal_summary",
    f"SELECT entity, season, count(DISTINCT week) AS weeks_active, {_summary_sql('yards')}, {_summary_sql('air')} FROM panel GROUP BY entity, season",
    "panel",
    " ".join(f"{s}_{c}" for c in ("yards", "air") for s in _SUMMARY),
)
def a4(spark, d):
    return A.seasonal_summary(D.panel(spark, d), ["entity", "season"], ["yards", "air"], "week")


@query(
    "a5_group_totals_on_rows",
    "SELECT entity, season, week, team, sum(yards) OVER w AS team_yards, sum(air) OVER w AS team_air FROM panel WINDOW w AS (PARTITION BY season, week, team)",
    "panel",
    "team_yards team_air",
)
def a5(spark, d):
    out = A.with_group_totals(D.panel(spark, d), ["season", "week", "team"], ["yards", "air"])
    return out.select("entity", "season", "week", "team", "team_yards", "team_air")


@query(
    "a6_distinct_counts",
    "SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey",
)
def a6(spark, d):
    return (
        D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"))
        .agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("flags"))
    )


_CLASSES = ["QB", "RB", "WR", "TE"]


@query(
    "a7_any_flag_by_category",
    "SELECT season, week, team, " + ", ".join(f"bool_or(position = '{p}' AND urgent > 0) AS has_{p.lower()}_out" for p in _CLASSES) + " FROM panel GROUP BY season, week, team",
    "panel",
)
def a7(spark, d):
    out = F.col("urgent") > 0
    return D.panel(spark, d).groupBy("season", "week", "team").agg(
        *[F.bool_or((F.col("position") == p) & out).alias(f"has_{p.lower()}_out") for p in _CLASSES]
    )


@query(
    "a8_global_quantile_labels",
    "SELECT o_orderkey, CASE WHEN o_totalprice > q80 THEN 'Top' WHEN o_totalprice > q66 THEN 'High' WHEN o_totalprice > q33 THEN 'Medium' ELSE 'Low' END AS volume, q33, q66, q80 "
    "FROM orders, (SELECT quantile_cont(o_totalprice, 0.33) AS q33, quantile_cont(o_totalprice, 0.66) AS q66, quantile_cont(o_totalprice, 0.8) AS q80 FROM orders)",
    doubles="q33 q66 q80",
)
def a8(spark, d):
    orders = D.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    q33, q66, q80 = exact_percentiles(orders, ["o_totalprice"], [0.33, 0.66, 0.8])["o_totalprice"]
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        F.when(price > q80, "Top").when(price > q66, "High").when(price > q33, "Medium").otherwise("Low").alias("volume"),
        F.lit(q33).alias("q33"), F.lit(q66).alias("q66"), F.lit(q80).alias("q80"),
    )


@query(
    "a9_prior_for_new_entities",
    "SELECT draft_round, volume, avg(yards) AS avg_yards FROM (SELECT coalesce(CAST(nullif(entity % 8, 0) AS VARCHAR), 'Undrafted') AS draft_round, CASE WHEN touches > 1 THEN 'High' ELSE 'Low' END AS volume, yards FROM panel) GROUP BY ALL",
    "panel",
    "avg_yards",
)
def a9(spark, d):
    return (
        D.panel(spark, d)
        .groupBy(
            F.coalesce(F.expr("CAST(nullif(entity % 8, 0) AS string)"), F.lit("Undrafted")).alias("draft_round"),
            F.when(F.col("touches") > 1, "High").otherwise("Low").alias("volume"),
        )
        .agg(F.avg("yards").alias("avg_yards"))
    )


_FORM_SQL = (
    "SELECT season, team, avg(CAST(won AS DOUBLE)) AS win_rate, avg(CASE WHEN venue = 'home' THEN CAST(won AS DOUBLE) END) AS win_rate_home, "
    "avg(CASE WHEN venue = 'away' THEN CAST(won AS DOUBLE) END) AS win_rate_away, avg(CASE WHEN won THEN diff END) AS diff_per_win FROM ("
    "SELECT season, home AS team, 'home' AS venue, home_score > away_score AS won, CAST(home_score - away_score AS DOUBLE) AS diff FROM games UNION ALL "
    "SELECT season, away, 'away', away_score > home_score, CAST(away_score - home_score AS DOUBLE) FROM games) GROUP BY season, team"
)


@query("a10_conditional_means", _FORM_SQL, "games", "win_rate win_rate_home win_rate_away diff_per_win")
def a10(spark, d):
    return season_form(D.games(spark, d))


def season_form(games):
    from ..operators.schema import team_rows

    rows = team_rows(games).select(
        "season", "team", "venue", (F.col("team_score") > F.col("opponent_score")).cast("double").alias("won"),
        (F.col("team_score") - F.col("opponent_score")).cast("double").alias("diff"),
    )

    def mean(c, cond=None):
        return F.avg(c) if cond is None else F.avg(F.when(cond, F.col(c)))

    return rows.groupBy("season", "team").agg(
        mean("won").alias("win_rate"),
        mean("won", F.col("venue") == "home").alias("win_rate_home"),
        mean("won", F.col("venue") == "away").alias("win_rate_away"),
        mean("diff", F.col("won") == 1.0).alias("diff_per_win"),
    )


@query(
    "a11_ordered_text",
    "SELECT season, team, string_agg('W' || week || ':' || CAST(yards AS BIGINT), ', ' ORDER BY week) AS form FROM teams GROUP BY season, team",
    "teams",
)
def a11(spark, d):
    df = D.teams(spark, d).withColumn("item", F.expr("concat('W', week, ':', CAST(yards AS bigint))"))
    return df.groupBy("season", "team").agg(A.ordered_text(["week"], "item", ", ").alias("form"))


@query(
    "a11_text_segments",
    "SELECT conv_id, turn // 4 AS segment, string_agg(text, chr(10) ORDER BY turn, text) AS joined_text, count(*) AS n_texts FROM conversations GROUP BY ALL",
)
def a11_segments(spark, d):
    df = D.table(spark, d, "conversations").select("conv_id", "turn", "text")
    return A.text_segments(df, ["conv_id"], "turn", "text", 4)


@query(
    "a12_fill_from_group_first",
    "SELECT entity, season, week, coalesce(air, first_air) AS air_filled FROM panel LEFT JOIN (SELECT entity, season, arg_min(air, week) AS first_air FROM panel WHERE air IS NOT NULL GROUP BY entity, season) USING (entity, season)",
    "panel",
    "air_filled",
)
def a12(spark, d):
    from ..operators.windows import Window

    group = Window.partitionBy("entity", "season").orderBy("week").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return D.panel(spark, d).select(
        "entity", "season", "week", F.coalesce("air", F.first("air", ignorenulls=True).over(group)).alias("air_filled")
    )


_LONG = (
    "SELECT season, week, team, opponent, 'P' || entity AS entity, CASE WHEN position IN ('WR', 'TE') THEN 'WR|TE' ELSE position END AS position, var, x "
    "FROM panel, LATERAL (SELECT unnest(['yards', 'air', 'touches']) AS var, unnest([yards, air, CAST(touches AS DOUBLE)]) AS x) WHERE x IS NOT NULL "
    "UNION ALL SELECT season, week, team, opponent, 'T' || team, 'Team', var, x FROM (SELECT t.*, t.score - o.score AS diff FROM teams t JOIN teams o ON t.season = o.season AND t.week = o.week AND t.opponent = o.team WHERE t.team <> t.opponent), "
    "LATERAL (SELECT unnest(['team_win', 'team_diff']) AS var, unnest([CAST(diff > 0 AS DOUBLE), CAST(diff AS DOUBLE)]) AS x)"
)
PAIR_SQL = (
    f"SELECT * FROM (WITH lng AS MATERIALIZED ({_LONG}) "
    "SELECT a.position AS position1, a.var AS var1, b.position AS position2, b.var AS var2, 'same_team' AS relation, count(*) AS n_pairs, corr(a.x, b.x) AS cor "
    "FROM lng a JOIN lng b ON a.season = b.season AND a.week = b.week AND a.team = b.team AND a.entity <> b.entity WHERE NOT (a.position = 'QB' AND b.position = 'QB') GROUP BY ALL "
    "UNION ALL SELECT a.position, a.var, b.position, b.var, 'opp_team', count(*), corr(a.x, b.x) FROM lng a JOIN lng b ON a.season = b.season AND a.week = b.week AND a.team = b.opponent GROUP BY ALL "
    "UNION ALL SELECT a.position, a.var, b.position, b.var, 'same_player', count(*), corr(a.x, b.x) FROM lng a JOIN lng b ON a.season = b.season AND a.week = b.week AND a.entity = b.entity AND a.var <> b.var WHERE a.position <> 'Team' GROUP BY ALL) "
    "WHERE abs(cor) >= 0.05 AND NOT isnan(cor)"
)


@query("a13_pair_correlation", PAIR_SQL, "panel teams", "cor")
def a13(spark, d):
    return correlations(spark, d)


def team_results(spark, d):
    """One row per team and week with the difference of the scores and whether the team won."""
    side = D.teams(spark, d).where("team <> opponent")
    other = side.select("season", "week", F.col("team").alias("opponent"), F.col("score").alias("against"))
    diff = F.col("score") - F.col("against")
    return side.join(other, ["season", "week", "opponent"]).select(
        "season", "week", "team", "opponent", (diff > 0).cast("double").alias("team_win"), diff.cast("double").alias("team_diff")
    )


def correlations(spark, d):
    panel = D.panel(spark, d).withColumn("touches", F.col("touches").cast("double"))
    return A.pair_correlations(
        panel, ["season", "week"], "team", "opponent", "position", ["yards", "air", "touches"],
        groups={"WR": "WR|TE", "TE": "WR|TE"}, team_rows=team_results(spark, d), team_measures=["team_win", "team_diff"],
    )


PAID_SQL = "SELECT *, CASE WHEN bet_hit THEN 100.0 * (1.0 + (CASE WHEN odds > 0 THEN odds ELSE 10000.0 / -odds END) / 100.0) ELSE 0.0 END AS paid FROM bets"


@query(
    "a14_return_rollup",
    f"SELECT season, response_var, sum(paid) AS payout, 100.0 * count(*) AS spent, count(*) AS num_bets, count(*) FILTER (WHERE bet_hit) AS num_won_bets, quantile_cont(odds, 0.5) AS med_odds, "
    f"(sum(paid) - 100.0 * count(*)) / (100.0 * count(*)) AS total_return FROM ({PAID_SQL}) GROUP BY season, response_var",
    "bets",
    "payout spent med_odds total_return",
    digits=5,
    fine="total_return",
)
def a14(spark, d):
    settled = A.settle(D.bets(spark, d), F.lit(100.0))
    return A.return_rollup(settled, ["season", "response_var"])


EV_SQL = "p * (CASE WHEN odds > 0 THEN odds ELSE 10000.0 / -odds END) - 100.0 * (1.0 - p)"
ODDS_BAND_SQL = "CASE WHEN odds < 0 THEN 'Negative Odds' WHEN odds < 250 THEN 'Positive Odds Up To +250' WHEN odds < 450 THEN 'Odds +251 to +450' WHEN odds < 650 THEN 'Odds +451 to +650' WHEN odds < 1000 THEN 'Odds +651 to +1000' WHEN odds < 2000 THEN 'Odds +1000 to +2000' ELSE 'Odds above +2000' END"
EV_BAND_SQL = "CASE WHEN ev > 100 THEN 'Very High' WHEN ev > 50 THEN 'High' WHEN ev > 20 THEN 'A little high' WHEN ev > 0 THEN 'Slightly above break-even' WHEN ev > -5 THEN 'Slightly below break-even' WHEN ev > -20 THEN 'A little low' WHEN ev > -30 THEN 'Low' WHEN ev > -50 THEN 'Very Low' ELSE 'Extremely Low' END"


def _slug(label: str) -> str:
    return label.lower().replace(" ", "_").replace("-", "_")


@query(
    "a15_return_pivot",
    f"SELECT {ODDS_BAND_SQL} AS odds_band, "
    + ", ".join(f"(sum(paid) FILTER (WHERE band = '{b}') - 100.0 * count(*) FILTER (WHERE band = '{b}')) / nullif(100.0 * count(*) FILTER (WHERE band = '{b}'), 0) AS {_slug(b)}" for b in C.EV_BANDS)
    + f" FROM (SELECT *, {EV_BAND_SQL} AS band FROM (SELECT *, {EV_SQL} AS ev FROM ({PAID_SQL}))) GROUP BY 1",
    "bets",
    " ".join(_slug(b) for b in C.EV_BANDS),
    digits=10,
)
def a15(spark, d):
    bands = A.settle(D.bets(spark, d), F.lit(100.0)).select(
        C.odds_band("odds")[0].alias("odds_band"),
        C.ev_band(C.expected_value("p", "odds"))[0].alias("band"),
        "result_payout", "amount",
    )
    table = bands.groupBy("odds_band").pivot("band", C.EV_BANDS).agg(
        F.try_divide(F.sum("result_payout") - F.sum("amount"), F.sum("amount"))
    )
    return table.select("odds_band", *[F.col(f"`{b}`").alias(_slug(b)) for b in C.EV_BANDS])


_REL = "probability_floor probability_ceiling pct_win mean_prediction"


@query("a16_reliability_table", reliability_sql("bets"), "bets", _REL)
def a16(spark, d):
    return A.reliability_table(D.bets(spark, d), "p", "bet_hit")


@query(
    "a17_calibration_score",
    f"SELECT season, sum(sqrt(n) * abs(pct_win - mean_prediction)) / sum(sqrt(n)) AS calibration_score FROM ({reliability_sql('bets', 'season,')}) WHERE n >= 10 GROUP BY season",
    "bets",
    "calibration_score",
)
def a17(spark, d):
    return A.calibration_score(A.reliability_table(D.bets(spark, d), "p", "bet_hit", ["season"]), ["season"])


CATEGORY_SQL = "CASE WHEN response_var LIKE '%rushing_receiving%' THEN 'Rush + Receiving' WHEN response_var LIKE '%receiving%' THEN 'Receiving' WHEN response_var LIKE '%rushing%' THEN 'Rushing' WHEN response_var LIKE '%passing%' THEN 'Passing' WHEN response_var LIKE '%receptions%' THEN 'Receptions' WHEN response_var LIKE '%anytime_td%' THEN 'ATD' WHEN response_var LIKE '%team%' THEN 'Team' ELSE 'Other' END"
IMPLIED_SQL = "CASE WHEN odds > 0 THEN 100.0 / (odds + 100.0) WHEN odds < 0 THEN -odds / (-odds + 100.0) END"


@query(
    "a18_model_vs_market",
    f"SELECT *, model_probability - actual_pct AS model_error, line_probability - actual_pct AS line_error FROM (SELECT {CATEGORY_SQL} AS category, {EV_BAND_SQL} AS ev_band, count(*) AS n, avg(CAST(bet_hit AS DOUBLE)) AS actual_pct, "
    f"avg(p) AS model_probability, avg({IMPLIED_SQL}) AS line_probability, avg(ev) AS avg_ev FROM (SELECT *, {EV_SQL} AS ev FROM bets) GROUP BY 1, 2)",
    "bets",
    "actual_pct model_probability line_probability avg_ev model_error line_error",
)
def a18(spark, d):
    labelled = D.bets(spark, d).select(
        "*", C.bet_category("response_var").alias("category"), C.ev_band(C.expected_value("p", "odds"))[0].alias("ev_band")
    )
    return A.market_comparison(labelled, ["category", "ev_band"])


@query(
    "a19_prevalence",
    "SELECT response_var, prevalence, n, CASE WHEN prevalence > 0 AND prevalence < 1 THEN -(prevalence * ln(prevalence) + (1 - prevalence) * ln(1 - prevalence)) ELSE 0.0 END AS baseline_log_loss "
    "FROM (SELECT response_var, avg(CAST(bet_hit AS DOUBLE)) AS prevalence, count(*) AS n FROM bets GROUP BY response_var)",
    "bets",
    "prevalence baseline_log_loss",
)
def a19(spark, d):
    return A.prevalence(D.bets(spark, d), ["response_var"], "bet_hit")
