"""Ledger and board queries (B18-B21, B23-B25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import ledger as L
from ..operators import schema as P
from ..operators import value as V
from ..operators.sets import first_per_key
from ..sources.tables import staged
from . import domain as D
from .registry import query
from .schema import TEAM_ROWS_SQL
from .value import PROFIT_SQL, VALUED_SQL

_LEDGER_SQL = (
    "SELECT *, 'B' || (q % 5) AS bettor, q * 1.0::DOUBLE AS amount, CASE WHEN q % 7 = 0 THEN NULL WHEN q % 11 = 0 THEN 'Refund' WHEN bet_hit THEN 'Win' ELSE 'Loss' END AS result FROM bets"
)
_PAID = f"CASE WHEN result = 'Win' THEN amount * (1.0 + {PROFIT_SQL} / 100.0) WHEN result = 'Refund' THEN amount WHEN result IS NOT NULL THEN 0.0 END"


def ledger(spark, d):
    return D.bets(spark, d).select(
        "*", F.expr("concat('B', q % 5)").alias("bettor"), F.col("q").cast("double").alias("amount"),
        F.expr("CASE WHEN q % 7 = 0 THEN NULL WHEN q % 11 = 0 THEN 'Refund' WHEN bet_hit THEN 'Win' ELSE 'Loss' END").alias("result"),
    )


def _summary_sql(by: str, src: str = _LEDGER_SQL) -> str:
    return (
        f"SELECT {by}, count(*) AS bets, count(*) FILTER (WHERE result = 'Win') AS wins, avg(CASE WHEN result = 'Win' THEN 1.0::DOUBLE ELSE 0.0 END) AS win_share, sum(amount) AS spent, sum({_PAID}) AS payout, (sum({_PAID}) - sum(amount)) / sum(amount) AS total_return FROM ({src}) WHERE result IS NOT NULL AND result <> 'Refund' GROUP BY ALL"
    )


@query("b18_ledger_by_bettor_week", _summary_sql("bettor, season, week"), "bets", "spent payout total_return win_share", digits=5, fine="total_return")
def b18(spark, d):
    return L.ledger_summary(ledger(spark, d), ["bettor", "season", "week"])


@query(
    "b18_ledger_by_odds_band",
    _summary_sql("CASE WHEN odds <= 0 THEN 'Negative Odds' WHEN odds <= 250 THEN 'Positive Odds Up To +250' WHEN odds <= 450 THEN 'Odds +251 to +450' WHEN odds <= 650 THEN 'Odds +451 to +650' WHEN odds <= 1000 THEN 'Odds +651 to +1000' WHEN odds <= 2000 THEN 'Odds +1000 to +2000' ELSE 'Odds above +2000' END AS odds_band", f"SELECT * FROM ({_LEDGER_SQL}) WHERE result <> 'Refund' QUALIFY row_number() OVER (PARTITION BY season, week, label ORDER BY bet_id) = 1"),
    "bets",
    "spent payout total_return win_share",
    digits=4,
    fine="total_return",
)
def b18_bands(spark, d):
    settled = ledger(spark, d).where("result <> 'Refund'")
    once = first_per_key(settled, ["season", "week", "label"], ["bet_id"])
    return L.ledger_summary(once.withColumn("odds_band", C.odds_band("odds", right=True)[0]), ["odds_band"])


@query(
    "b19_unsettled_bets",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 7 = 0 AND l_shipdate < TIMESTAMP '2000-06-01 12:00:00' - INTERVAL 3 HOUR",
)
def b19(spark, d):
    items = D.table(spark, d, "lineitem").withColumn("result", F.expr("CASE WHEN CAST(l_quantity AS bigint) % 7 = 0 THEN NULL ELSE 'Loss' END"))
    now = F.lit("2000-06-01 12:00:00").cast("timestamp_ntz")
    return L.unsettled(items, now, "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_PICK_SQL = "SELECT season, week, CASE WHEN home_score > away_score THEN home ELSE away END AS pick, CASE WHEN home_score > away_score THEN 'vs ' || away || ' - Home' ELSE 'vs ' || home || ' - Away' END AS detail FROM games WHERE abs(home_score - away_score) >= 4"


def _picks(spark, d):
    home = F.col("home_score") > F.col("away_score")
    return D.games(spark, d).where(F.abs(F.col("home_score") - F.col("away_score")) >= 4).select(
        "season", "week", F.when(home, F.col("home")).otherwise(F.col("away")).alias("pick"),
        F.when(home, F.concat(F.lit("vs "), "away", F.lit(" - Home"))).otherwise(F.concat(F.lit("vs "), "home", F.lit(" - Away"))).alias("detail"),
    )


@query(
    "b20_pick_options",
    f"SELECT season, week, count(*) AS safe_picks, string_agg(CAST(pick AS VARCHAR), ',' ORDER BY pick) AS picks, string_agg(detail, '; ' ORDER BY pick) AS details, count(*) = 1 AS only_choice, count(*) = 2 AS two_choices FROM ({_PICK_SQL}) GROUP BY season, week",
    "games",
)
def b20(spark, d):
    out = L.pick_options(_picks(spark, d), ["season", "week"], "pick", "detail")
    return out.withColumns({"only_choice": F.col("safe_picks") == 1, "two_choices": F.col("safe_picks") == 2})


@query(
    "b20_weeks_per_team",
    f"SELECT n_nationkey AS team, coalesce(num_weeks, 0) AS num_weeks, coalesce(options, '') AS options FROM nation LEFT JOIN (SELECT pick, count(DISTINCT (season, week)) AS num_weeks, string_agg('Week ' || (season * 100 + week), '; ' ORDER BY season, week) AS options FROM ({_PICK_SQL}) GROUP BY pick) ON pick = n_nationkey",
    "games",
)
def b20_teams(spark, d):
    teams = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("team"))
    picks = _picks(spark, d).withColumn("week", F.col("season") * 100 + F.col("week"))
    return L.picks_per_team(picks, teams, "team", "pick", "week")


@query(
    "b21_detail_cards",
    f"WITH r AS MATERIALIZED (SELECT t.*, CASE WHEN venue = 'home' THEN home_yards ELSE away_yards END AS yards FROM ({TEAM_ROWS_SQL}) t JOIN games USING (game_id)), "
    "f AS (SELECT season, week, team, opponent, venue, coalesce(sum(CAST(team_score > opponent_score AS INT)) OVER m, 0) || '-' || coalesce(sum(1 - CAST(team_score > opponent_score AS INT)) OVER m, 0) AS head_to_head, "
    "lag(season || ' W' || week || ': ' || team_score || '-' || opponent_score) OVER (PARTITION BY team, opponent ORDER BY season, week) AS last_meeting, avg(CAST(team_score > opponent_score AS INT)::DOUBLE) OVER s AS season_win_rate, "
    "avg(CASE WHEN venue = 'home' THEN CAST(team_score > opponent_score AS INT)::DOUBLE END) OVER s AS season_home_win_rate, coalesce(array_to_string(list_transform(array_agg(yards) OVER l, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ', '), '') AS last3_values FROM r "
    "WINDOW m AS (PARTITION BY team, opponent ORDER BY season, week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY team, season ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), l AS (PARTITION BY team ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) "
    "SELECT f.*, last_season_avg, opponent_defence_rank FROM f LEFT JOIN (SELECT season + 1 AS season, team, avg(yards) AS last_season_avg FROM r GROUP BY season, team) a ON a.team = f.team AND a.season = f.season LEFT JOIN (SELECT season + 1 AS season, opponent, rank() OVER (PARTITION BY season ORDER BY sum(yards)) AS opponent_defence_rank FROM r GROUP BY season, opponent) k ON k.opponent = f.opponent AND k.season = f.season",
    "games",
    "season_win_rate season_home_win_rate last_season_avg",
    digits=9,
)
def b21(spark, d):
    games = D.games(spark, d)
    rows = P.team_rows(games).join(games.select("game_id", "home_yards", "away_yards"), "game_id").withColumn(
        "yards", F.when(F.col("venue") == "home", F.col("home_yards")).otherwise(F.col("away_yards"))
    )
    return L.detail_cards(staged(rows, "team-rows"), "yards")


_NEUTRAL = "(team + opponent + week) % 10 = 0"  # the games have no such mark; a rule stands for it
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _rate_sql(venue: str) -> str:
    return f"avg(CASE WHEN venue = '{venue}' THEN CAST(team_score > opponent_score AS INT)::DOUBLE END)"


@query(
    "b21_venue_win_rates",
    f"WITH r AS MATERIALIZED (SELECT season, week, team, opponent, team_score, opponent_score, CASE WHEN {_NEUTRAL} THEN 'neutral' ELSE venue END AS venue FROM ({TEAM_ROWS_SQL})), "
    f"f AS (SELECT season, week, team, opponent, venue, {', '.join(f'{_rate_sql(v)} OVER s AS season_{v}_win_rate' for v in L.VENUES)} FROM r WINDOW s AS (PARTITION BY team, season ORDER BY week {_BEFORE})) "
    f"SELECT f.*, {', '.join(f'last_season_{v}_win_rate' for v in L.VENUES)} FROM f LEFT JOIN (SELECT season + 1 AS season, team, {', '.join(f'{_rate_sql(v)} AS last_season_{v}_win_rate' for v in L.VENUES)} FROM r GROUP BY season, team) p "
    "ON p.team = f.team AND p.season = f.season",
    "games",
    " ".join(f"season_{v}_win_rate last_season_{v}_win_rate" for v in L.VENUES),
    digits=9,
)
def b21_venues(spark, d):
    rows = P.team_rows(D.games(spark, d)).withColumn("venue", F.when(F.expr(_NEUTRAL), "neutral").otherwise(F.col("venue")))
    return L.venue_win_rates(staged(rows.select("season", "week", "team", "opponent", "team_score", "opponent_score", "venue"), "venues"))


@query(
    "b21_player_cards",
    f"WITH f AS (SELECT entity, position, season, week, opponent, count(air) OVER m AS games_against, avg(air) OVER m AS avg_against, last_value(CASE WHEN air IS NOT NULL THEN season || ' W' || week || ': ' || CAST(air AS BIGINT) END IGNORE NULLS) OVER m AS last_against, "
    "avg(air) OVER s AS season_avg, max(air) OVER s AS season_best, coalesce(array_to_string(list_transform(list_filter(array_agg(air) OVER l, lambda v: v IS NOT NULL), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ', '), '') AS last3_values FROM panel "
    f"WINDOW m AS (PARTITION BY entity, opponent ORDER BY season, week {_BEFORE}), s AS (PARTITION BY entity, season ORDER BY week {_BEFORE}), l AS (PARTITION BY entity ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) "
    "SELECT f.*, last_season_avg, last_season_games, opponent_rank FROM f LEFT JOIN (SELECT season + 1 AS season, entity, avg(air) AS last_season_avg, count(air) AS last_season_games FROM panel GROUP BY season, entity) o ON o.entity = f.entity AND o.season = f.season "
    "LEFT JOIN (SELECT season + 1 AS season, position, opponent, rank() OVER (PARTITION BY season, position ORDER BY sum(air)) AS opponent_rank FROM panel GROUP BY season, position, opponent HAVING sum(air) IS NOT NULL) k ON k.season = f.season AND k.position = f.position AND k.opponent = f.opponent",
    "panel",
    "avg_against season_avg season_best last_season_avg",
)
def b21_players(spark, d):
    rows = D.panel(spark, d).select("entity", "position", "season", "week", "opponent", "air")
    return L.player_cards(staged(rows, "players"), "air")


@query(
    "b23_upcoming_board",
    "WITH w AS (SELECT season, week, team, max(p) AS p FROM bets WHERE response_var = 'team_win' GROUP BY ALL), s AS (SELECT season, week, team, min(CAST(replace(replace(response_var, 'team_differential_', ''), 'minus', '-') AS DOUBLE)) AS spread FROM bets WHERE response_var LIKE 'team_differential%' GROUP BY ALL) "
    "SELECT g.game_id, g.season, g.week, g.home, g.away, h.n_name AS home_name, a.n_name AS away_name, wh.p AS home_probability, wa.p AS away_probability, s.spread FROM games g LEFT JOIN nation h ON h.n_nationkey = g.home LEFT JOIN nation a ON a.n_nationkey = g.away "
    "LEFT JOIN w wh ON wh.season = g.season AND wh.week = g.week AND wh.team = g.home LEFT JOIN w wa ON wa.season = g.season AND wa.week = g.week AND wa.team = g.away LEFT JOIN s ON s.season = g.season AND s.week = g.week AND s.team = g.home WHERE g.season > 2000 OR (g.season = 2000 AND g.week >= 30)",
    "games bets",
    "home_probability away_probability spread",
)
def b23(spark, d):
    bets = D.bets(spark, d)
    week = ["season", "week", "team"]
    wins = bets.where("response_var = 'team_win'").groupBy(*week).agg(F.max("p").alias("p"))
    spreads = bets.where("response_var LIKE 'team_differential%'").groupBy(*week).agg(F.min(C.ladder_number("response_var")).alias("spread"))
    names = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("team"), F.col("n_name").alias("name"))
    schedule = D.games(spark, d).select("game_id", "season", "week", "home", "away")
    after = (F.col("season") > 2000) | ((F.col("season") == 2000) & (F.col("week") >= 30))
    return L.upcoming_board(schedule, spreads, wins, names, after)


@query(
    "b24_weekly_sheet",
    f"WITH o AS (SELECT DISTINCT season, week, least(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) || '-' || greatest(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) AS game_key, label, response_var, bettor FROM ({_LEDGER_SQL}) WHERE result IS NULL), "
    "g AS (SELECT season, week, least(CAST(home AS VARCHAR), CAST(away AS VARCHAR)) || '-' || greatest(CAST(home AS VARCHAR), CAST(away AS VARCHAR)) AS game_key, game_id, CASE WHEN home % 3 = 0 THEN 'Early' WHEN home % 3 = 1 THEN 'Late' ELSE 'Night' END AS slot FROM games) "
    "SELECT season, week, game_key, label, response_var, bettors, game_id, slot FROM (SELECT season, week, game_key, label, response_var, string_agg(bettor, ', ' ORDER BY bettor) AS bettors FROM o GROUP BY ALL) LEFT JOIN g USING (season, week, game_key)",
    "games bets",
)
def b24(spark, d):
    games = D.games(spark, d).withColumn("slot", F.expr("CASE WHEN home % 3 = 0 THEN 'Early' WHEN home % 3 = 1 THEN 'Late' ELSE 'Night' END"))
    return L.weekly_sheet(ledger(spark, d).where("result IS NULL"), games, ["season", "week"])


@query(
    "b25_recommendations",
    f"SELECT bet_id, n_name AS opponent_name, 25.0 * (1.0 + profit_per_100 / 100.0) AS payout_of_25, profit_per_100 / 100.0 AS return_on_stake, CASE WHEN odds > 0 THEN 100.0 / (odds + 100.0) ELSE -odds / (-odds + 100.0) END AS line_probability, ev FROM ({VALUED_SQL}) LEFT JOIN nation ON n_nationkey = opponent WHERE ev > 0",
    "bets",
    "payout_of_25 return_on_stake line_probability ev",
)
def b25(spark, d):
    names = D.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("opponent"), F.col("n_name").alias("opponent_name"))
    valued = V.expected_value_and_risk(D.bets(spark, d))
    listed = valued.join(names, "opponent", "left").select(
        "bet_id", "opponent_name", C.payout(F.lit(25.0), "odds").alias("payout_of_25"),
        (F.col("profit_per_100") / 100.0).alias("return_on_stake"), C.implied_probability("odds").alias("line_probability"), "ev",
    )
    return listed.orderBy(F.desc("ev"), "bet_id")
