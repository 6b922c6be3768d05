"""Odds, value and return queries (B1-B6, B14-B17, B22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import aggregates as A
from ..operators import value as V
from ..operators import windows as W
from . import domain as D
from .aggregates import EV_SQL, reliability_sql
from .registry import query

PROFIT_SQL = "(CASE WHEN odds > 0 THEN odds ELSE 10000.0 / -odds END)"
TYPE_SQL = "CASE WHEN response_var IN ('anytime_td_scorer', 'team_win') THEN response_var ELSE regexp_replace(response_var, '_[^_]*$', '') END"
CAP_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.EV_CAPS.items()) + " END"
VALUED_SQL = f"SELECT *, {TYPE_SQL} AS type, {PROFIT_SQL} AS profit_per_100, {EV_SQL} AS ev, p * (1.0 - p) * ({PROFIT_SQL} / 100.0 + 1.0) * ({PROFIT_SQL} / 100.0 + 1.0) AS risk_raw FROM bets"
TIER_SQL = "CASE length(response_var) % 4 WHEN 0 THEN 'Extra Strong' WHEN 1 THEN 'Strong' WHEN 2 THEN 'Medium' ELSE 'Weakest' END"

CLOSING_SQL = "SELECT * FROM lines WHERE run_time < start_time - INTERVAL 10 MINUTE QUALIFY row_number() OVER (PARTITION BY user_id, event_type, start_time ORDER BY run_time DESC, event_id DESC) = 1"


@query("b1_closing_lines", f"SELECT user_id, event_type, CAST(start_time AS VARCHAR) AS start_time, event_id, price FROM ({CLOSING_SQL})", "lines")
def b1(spark, d):
    lines = D.lines(spark, d).select("user_id", "event_type", "start_time", "event_id", "price", "run_time")
    out = V.closing_lines(lines, ["user_id", "event_type", "start_time"], "run_time", "start_time")
    return out.select("user_id", "event_type", F.col("start_time").cast("string"), "event_id", "price")


MARKETS = {"click": "Receptions", "view": "Rush + Rec Yards", "purchase": "Spread Alternate", "signup": "Pass Yards", "error": "Anytime TD Scorer"}
FAMILIES = {
    "Receptions": V.Family("receptions"), "Rush + Rec Yards": V.Family("rushing_receiving_yards"), "Pass Yards": V.Family("passing_yards"),
    "Spread": V.Family("team_differential", flip=True), "Spread Alternate": V.Family("team_differential", flip=True),
    "Anytime TD Scorer": V.Family("anytime_td_scorer", has_rung=False), "Moneyline": V.Family("team_win", has_rung=False),
}


def market():
    """A third of the spreads are main spreads, half of the scorer lines moneylines."""
    main = (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)
    winner = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)
    return F.when(main, "Spread").when(winner, "Moneyline").otherwise(V.choose("event_type", MARKETS))


def ladder_targets(spark):
    """All target codes: a few dozen rows of fixed thresholds."""
    rungs = (
        [("passing_yards", float(n)) for n in D.PASSING_LADDER]
        + [(r, float(n)) for r in ("rushing_yards", "receiving_yards") for n in D.YARD_LADDER]
        + [("rushing_receiving_yards", float(n)) for n in D.COMBINED_LADDER]
        + [("receptions", float(n)) for n in D.RECEPTION_LADDER]
        + [("team_differential", n) for n in D.SPREAD_LADDER]
    )
    coded = spark.createDataFrame(rungs, "root string, number double").select(C.ladder_code("root", "number").alias("response_var"))
    return coded.unionByName(spark.createDataFrame([("anytime_td_scorer",), ("team_win",)], "response_var string"))


def _in(values) -> str:
    return ", ".join(str(v) for v in values)


TARGET_SQL = (
    "SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'team_win' ELSE 'anytime_td_scorer' END WHEN 'click' THEN 'receptions_' || number WHEN 'view' THEN 'rushing_receiving_yards_' || number WHEN 'signup' THEN 'passing_yards_' || number "
    "ELSE 'team_differential_' || CASE WHEN -points < 0 THEN 'minus' ELSE '' END || CASE WHEN points = floor(points) THEN CAST(CAST(abs(points) AS BIGINT) AS VARCHAR) ELSE CAST(abs(points) AS VARCHAR) END END AS response_var FROM (SELECT *, k * 2 AS number FROM lines) "
    f"WHERE event_type = 'error' OR (event_type = 'click' AND number IN ({_in(D.RECEPTION_LADDER)})) OR (event_type = 'view' AND number IN ({_in(D.COMBINED_LADDER)})) OR (event_type = 'signup' AND number IN ({_in(D.PASSING_LADDER)})) OR (event_type = 'purchase' AND points IN ({_in(D.SPREAD_LADDER)}))"
)


@query("b2_market_targets", TARGET_SQL, "lines")
def b2(spark, d):
    lines = D.lines(spark, d).select(
        "event_id", market().alias("market"), "points", (F.col("k") * 2).cast("double").alias("number")
    )
    return V.market_targets(lines, "market", "points", "number", FAMILIES, ladder_targets(spark)).select("event_id", "response_var")


_TYPES = "['click', 'view', 'purchase', 'signup', 'error']"
_PRED_SQL = (
    f"SELECT label, target, gameday, arg_max(p, run) AS p, arg_max(opens, run) AS opens FROM (SELECT o_custkey AS label, ({_TYPES})[CAST(o_orderkey % 3 + 1 AS INTEGER)] AS target, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS gameday, "
    "(o_orderkey % 97) / CAST(97.0 AS DOUBLE) AS p, CASE WHEN o_orderkey % 11 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (o_orderkey % 30) + INTERVAL 1 HOUR * (o_orderkey % 24) END AS opens, o_orderkey AS run FROM orders) GROUP BY ALL"
)
_MATCH_SQL = (
    "SELECT user_id, event_type AS target, CAST(c.gameday AS VARCHAR) AS gameday, odds, p, CASE WHEN odds > 0 THEN 100.0 / (odds + 100.0) ELSE -odds / (-odds + 100.0) END AS implied_probability, opens FROM ("
    f"SELECT user_id, event_type, CAST(start_time AS DATE) AS gameday, CAST(replace(replace(american_odds, '−', '-'), '+', '') AS DOUBLE) AS odds FROM ({CLOSING_SQL})) c LEFT JOIN ({_PRED_SQL}) q ON q.label = c.user_id AND q.target = c.event_type AND q.gameday = c.gameday"
)


def _matched(spark, d):
    closing = V.closing_lines(D.lines(spark, d), ["user_id", "event_type", "start_time"], "run_time", "start_time")
    lines = closing.select(
        "user_id", F.col("event_type").alias("target"), F.to_date("start_time").alias("gameday"), C.american_to_number("american_odds").alias("odds")
    )
    key = F.col("o_orderkey")
    opens = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(o_orderkey % 30 AS int), CAST(o_orderkey % 24 AS int))")
    runs = D.table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), F.element_at(F.array(*[F.lit(t) for t in MARKETS]), (key % 3 + 1).cast("int")).alias("target"),
        F.expr("date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS int))").alias("gameday"),
        (key % 97 / F.lit(97.0)).alias("p"), F.when(key % 11 > 0, opens).alias("opens"), key.alias("run"),
    )
    keys = ["user_id", "target", "gameday"]
    return V.match_predictions(lines, W.latest_per_key(runs, keys, ["run"]).drop("run"), keys)


@query(
    "b3_match_predictions",
    f"SELECT user_id, target, gameday, odds, p, implied_probability FROM ({_MATCH_SQL}) WHERE opens IS NULL OR opens > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 1 HOUR",
    "lines",
    "odds p implied_probability",
)
def b3(spark, d):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    return V.still_open(_matched(spark, d), "opens", now).select(
        "user_id", "target", F.col("gameday").cast("string"), "odds", "p", "implied_probability"
    )


@query(
    "b3_unmatched_labels",
    f"SELECT user_id, count(*) AS lines FROM ({_MATCH_SQL}) GROUP BY user_id HAVING count(p) = 0",
    "lines",
)
def b3_unmatched(spark, d):
    return V.unmatched_labels(_matched(spark, d), "user_id", "p")


@query(
    "b4_settlement",
    f"SELECT bet_id, measure, coalesce(CASE WHEN type IN ('anytime_td_scorer', 'team_win') THEN measure > 0 WHEN type = 'team_differential' THEN measure > number ELSE measure >= number END, FALSE) AS bet_won FROM ("
    f"SELECT *, {TYPE_SQL} AS type, CAST(nullif(regexp_extract(replace(response_var, 'minus', '-'), '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number, CAST(CASE WHEN response_var LIKE 'receptions%' THEN q // 4 WHEN response_var LIKE 'team%' THEN q - 25 WHEN response_var LIKE 'any%' THEN q % 2 ELSE q * 5 END AS DOUBLE) AS measure FROM bets)",
    "bets",
    "measure",
)
def b4(spark, d):
    kind = F.col("response_var")
    df = D.bets(spark, d).select(
        "bet_id", C.bet_type("response_var").alias("type"), C.ladder_number("response_var").alias("number"),
        F.when(kind.like("receptions%"), F.expr("q div 4")).when(kind.like("team%"), F.col("q") - 25)
        .when(kind.like("any%"), F.col("q") % 2).otherwise(F.col("q") * 5).cast("double").alias("measure"),
    )
    return df.select("bet_id", "measure", V.bet_won("type", "number", "measure").alias("bet_won"))


@query(
    "b5_expected_value",
    f"SELECT bet_id, type, profit_per_100, ev, risk_raw, risk_raw AS risk_score FROM ({VALUED_SQL}) WHERE ev > 0 AND ev <= {CAP_SQL}",
    "bets",
    "profit_per_100 ev risk_raw risk_score",
)
def b5(spark, d):
    out = V.expected_value_and_risk(D.bets(spark, d), caps=True)
    return out.select("bet_id", "type", "profit_per_100", "ev", "risk_raw", "risk_score")


def model_tiers(bets):
    """Tier per target, a stand-in for the selection table."""
    tier = V.choose(F.length("response_var") % 4, {0: "Extra Strong", 1: "Strong", 2: "Medium"}, "Weakest")
    return bets.select("response_var").distinct().withColumn("model_assessment", tier)


@query(
    "b5_penalised_risk",
    f"WITH rel AS ({reliability_sql('bets', 'response_var,')}) SELECT b.bet_id, b.ev, b.risk_raw * (CASE {TIER_SQL.replace('response_var', 'b.response_var')} WHEN 'Extra Strong' THEN 1.0 WHEN 'Strong' THEN 1.5 WHEN 'Medium' THEN 2.0 ELSE 3.0 END) * "
    f"(CASE rel.assessment WHEN 'Inside Target Range' THEN 1.0 WHEN 'Near Target Range' THEN 1.5 WHEN 'Bad' THEN 3.0 ELSE 2.0 END) AS risk_score FROM ({VALUED_SQL}) b LEFT JOIN rel ON rel.response_var = b.response_var AND round(b.p * 10000) >= round(rel.probability_floor * 10000) AND round(b.p * 10000) < round(rel.probability_ceiling * 10000)",
    "bets",
    "ev risk_score",
)
def b5_penalised(spark, d):
    bets = D.bets(spark, d)
    verdicts = A.reliability_table(bets, "p", "bet_hit", ["response_var"])
    out = V.expected_value_and_risk(bets, positive_only=False, model_tiers=model_tiers(bets), bin_verdicts=verdicts)
    return out.select("bet_id", "ev", "risk_score")


_RUNGS_SQL = (
    "SELECT season, week, label, regexp_replace(response_var, '_(minus)?[0-9]+([.][0-9]+)?$', '') AS root, CAST(nullif(regexp_extract(replace(response_var, 'minus', '-'), '-?[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE) AS number, max(p) AS p FROM bets GROUP BY ALL"
)


@query(
    "b6_ladder_screen",
    f"SELECT season, week, label, root, number, p FROM (SELECT *, lag(p) OVER (PARTITION BY season, week, label, root ORDER BY number) AS prev FROM ({_RUNGS_SQL})) WHERE number IS NULL OR NOT coalesce(p > prev + 0.05, FALSE)",
    "bets",
    "number p",
)
def b6(spark, d):
    rungs = D.bets(spark, d).groupBy(
        "season", "week", "label", C.ladder_root("response_var").alias("root"), C.ladder_number("response_var").alias("number")
    ).agg(F.max("p").alias("p"))
    return V.without_ladder_violations(rungs, ["season", "week", "label", "root"])


_TOPN_SQL = (
    "SELECT cap AS odds_cap, n AS num_bets, (sum(w * paid) - sum(w * 100.0)) / sum(w * 100.0) AS total_return, quantile_cont(odds, 0.5) AS median_odds FROM ("
    "SELECT cap, n, 1.0::DOUBLE / n AS w, odds, CASE WHEN bet_hit THEN 100.0 + profit_per_100 ELSE 0.0 END AS paid FROM (SELECT *, row_number() OVER (PARTITION BY cap, season, week ORDER BY ev DESC, bet_id) AS rn FROM ("
    f"SELECT 'No Odds Cap' AS cap, * FROM ({VALUED_SQL}) WHERE ev > 0 AND ev <= {CAP_SQL} UNION ALL SELECT '+1000 Odds Cap', * FROM ({VALUED_SQL}) WHERE ev > 0 AND ev <= {CAP_SQL} AND odds < 1000)), (SELECT unnest(generate_series(1, 20)) AS n) WHERE rn <= n) GROUP BY ALL"
)


@query("b14_straight_bets", _TOPN_SQL, "bets", "total_return median_odds", fine="total_return")
def b14(spark, d):
    valued = V.expected_value_and_risk(D.bets(spark, d), caps=True)
    capped = V.straight_bets(valued.where("odds < 1000"), ["season", "week"]).withColumn("odds_cap", F.lit("+1000 Odds Cap"))
    return V.straight_bets(valued, ["season", "week"]).withColumn("odds_cap", F.lit("No Odds Cap")).unionByName(capped)


_SETTLED_SQL = f"SELECT season, week, odds, bet_hit, q * 1.0::DOUBLE AS amount, {PROFIT_SQL} AS profit, CASE WHEN bet_hit THEN q * (1.0 + {PROFIT_SQL} / 100.0) ELSE 0.0 END AS paid FROM bets"
_BASE_SQL = f"SELECT season, sum(paid) AS payout, sum(amount) AS spent, count(*) FILTER (WHERE bet_hit) AS num_wins, max(paid) AS largest, (sum(paid) - sum(amount)) / sum(amount) AS baseline_return FROM ({_SETTLED_SQL}) GROUP BY season"
_WINS_SQL = f"SELECT season, paid, row_number() OVER (PARTITION BY season ORDER BY profit DESC, paid DESC) AS rn, sum(paid) OVER (PARTITION BY season ORDER BY profit DESC, paid DESC ROWS UNBOUNDED PRECEDING) AS cum FROM ({_SETTLED_SQL}) WHERE bet_hit"


def _settled(spark, d):
    return A.settle(D.bets(spark, d).select("season", "week", "odds", "bet_hit", "q"), F.col("q").cast("double"))


@query(
    "b15_win_removal_stress",
    f"WITH base AS ({_BASE_SQL}), wins AS ({_WINS_SQL}), cases AS (SELECT base.*, 'top ' || k AS scenario, k FROM base, (SELECT unnest([1, 2, 3, 5, 10]) AS k) UNION ALL SELECT base.*, 'top ' || pc || '%', CAST(ceil(num_wins * (pc / CAST(100.0 AS DOUBLE))) AS BIGINT) FROM base, (SELECT unnest([5, 10, 20, 30]) AS pc)) "
    "SELECT *, baseline_return - adjusted_return AS return_drop, adjusted_return / nullif(baseline_return, 0) AS retained_share FROM (SELECT c.season, scenario, k AS k_wins_removed, num_wins, baseline_return, (payout - coalesce((SELECT sum(paid) FROM wins w WHERE w.season = c.season AND rn <= k), 0) - spent) / spent AS adjusted_return FROM cases c)",
    "bets",
    "baseline_return adjusted_return return_drop retained_share",
    digits=10,
)
def b15(spark, d):
    return V.win_removal_stress(_settled(spark, d), ["season"])


@query(
    "b15_wins_to_break_even",
    f"WITH base AS ({_BASE_SQL}), wins AS ({_WINS_SQL}) SELECT *, wins_to_break_even / CAST(num_wins AS DOUBLE) AS share_to_break_even FROM (SELECT season, baseline_return, num_wins, (SELECT min(rn) FROM wins w WHERE w.season = b.season AND b.payout - w.cum <= b.spent) AS wins_to_break_even, (payout - largest - spent) / spent AS worst_single_removal FROM base b)",
    "bets",
    "baseline_return share_to_break_even worst_single_removal",
    digits=10,
)
def b15_break_even(spark, d):
    return V.wins_to_break_even(_settled(spark, d), ["season"])


@query(
    "b16_weekly_reliability",
    f"SELECT season, (sum(payout) - sum(spent)) / sum(spent) AS season_return, avg(r) AS avg_weekly_return, quantile_cont(r, 0.5) AS median_weekly_return, stddev_samp(r) AS weekly_sd, min(r) AS min_week, avg(CAST(r > 0 AS INT)::DOUBLE) AS pct_profitable_weeks, "
    f"avg(CAST(r <= -1 AS INT)::DOUBLE) AS pct_weeks_down_100, count(*) AS num_weeks FROM (SELECT season, week, sum(paid) AS payout, sum(amount) AS spent, (sum(paid) - sum(amount)) / sum(amount) AS r FROM ({_SETTLED_SQL}) GROUP BY season, week) GROUP BY season",
    "bets",
    "season_return avg_weekly_return median_weekly_return weekly_sd min_week pct_profitable_weeks pct_weeks_down_100",
    digits=10,
)
def b16(spark, d):
    return V.weekly_reliability(_settled(spark, d), ["season"], ["week"])


_DAY_SQL = "CASE WHEN day_of_week IN (4, 5, 6) THEN 'thursday' WHEN day_of_week IN (1, 7) THEN 'sunday' WHEN day_of_week = 2 THEN 'monday' END"


@query(
    "b17_bankroll_split",
    f"WITH w AS (SELECT season, week, day_group, bet_hit, odds, ev / sum(ev) OVER (PARTITION BY season, week, day_group) * (CASE day_group WHEN 'sunday' THEN 0.6 ELSE 0.2 END) AS pw FROM (SELECT *, {_DAY_SQL} AS day_group FROM ({VALUED_SQL}) WHERE ev > 0) WHERE day_group IS NOT NULL) "
    f"SELECT season, day_group, sum(CASE WHEN bet_hit THEN pw * 50.0 * (1.0 + {PROFIT_SQL} / 100.0) ELSE 0.0 END) AS payout, sum(pw * 50.0) AS spent, count(*) AS num_bets FROM w GROUP BY season, day_group",
    "bets",
    "payout spent",
)
def b17(spark, d):
    valued = V.expected_value_and_risk(D.bets(spark, d)).withColumn("weight", F.col("ev"))
    staked = V.bankroll_split(valued, "day_of_week", 50.0, ["season", "week"])
    paid = F.when(F.col("bet_hit"), C.payout("amount", "odds")).otherwise(0.0)
    return staked.groupBy("season", "day_group").agg(
        F.sum(paid).alias("payout"), F.sum("amount").alias("spent"), F.count("*").alias("num_bets")
    )


@query(
    "b22_blanket_bets",
    " UNION ALL ".join(
        f"SELECT '{name}' AS rule, 100.0 * count(*) AS spent, coalesce(sum(CASE WHEN bet_hit THEN profit_per_100 + 100.0 ELSE 0.0 END), 0.0) AS payout, (coalesce(sum(CASE WHEN bet_hit THEN profit_per_100 + 100.0 ELSE 0.0 END), 0.0) - 100.0 * count(*)) / nullif(100.0 * count(*), 0) AS total_return FROM ({VALUED_SQL}) WHERE {cond}"
        for name, cond in (("all bets", "TRUE"), ("ev above 0", "ev > 0"), ("ev above 25", "ev > 25"), ("ev above 50", "ev > 50"))
    ),
    "bets",
    "spent payout total_return",
    digits=4,
    fine="total_return",
)
def b22(spark, d):
    return V.blanket_bets(D.bets(spark, d), [None, 0.0, 25.0, 50.0])
