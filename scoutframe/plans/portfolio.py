"""Portfolio queries (B7-B13, J13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import portfolio as R
from ..operators import value as V
from ..operators import windows as W
from ..sources.tables import staged
from . import domain as D
from .aggregates import PAIR_SQL, correlations
from .registry import query
from .value import CAP_SQL, VALUED_SQL

# measure of the correlation table that stands for each bet type
VARS = {
    "passing_yards": "yards", "receiving_yards": "yards", "rushing_receiving_yards": "yards",
    "rushing_yards": "air", "receptions": "touches", "anytime_td_scorer": "touches", "team_differential": "team_diff",
}
_VAR_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VARS.items()) + " ELSE type END"
WEEK = ["season", "week"]

POOL_SQL = (
    f"SELECT season, week, bet_id, label || '@' || team AS label, CASE WHEN position = 'team' THEN 'Team' ELSE position END AS position, team, opponent, {_VAR_SQL} AS var, ev, risk_raw AS risk_score, "
    "least(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) || '-' || greatest(CAST(team AS VARCHAR), CAST(opponent AS VARCHAR)) AS game "
    f"FROM ({VALUED_SQL}) WHERE ev > 0 AND ev <= {CAP_SQL} AND team <> opponent "
    "QUALIFY row_number() OVER (PARTITION BY season, week, label, team, response_var ORDER BY bet_id DESC) = 1"
)


def pool(spark, d):
    """Bets that may enter a portfolio: one per week, player and target."""
    valued = V.expected_value_and_risk(D.bets(spark, d), caps=True).where("team <> opponent")
    valued = W.latest_per_key(valued, ["season", "week", "label", "team", "response_var"], ["bet_id"])
    return valued.select(
        "season", "week", "bet_id", F.concat("label", F.lit("@"), "team").alias("label"),
        F.when(F.col("position") == "team", "Team").otherwise(F.col("position")).alias("position"), "team", "opponent",
        V.choose("type", VARS, F.col("type")).alias("var"), "ev", "risk_score", C.pair_key("team", "opponent").alias("game"),
        "odds", "bet_hit",
    )


def coefs(spark, d):
    """The coefficient table; cut off from its long plan because several joins read it."""
    return staged(R.coefficients(correlations(spark, d)), "coefficients")


@query(
    "b7_correlation_table",
    f"SELECT *, (SELECT min(season) FROM panel) AS min_year, (SELECT max(season) FROM panel) AS max_year, '2024-01-01' AS created_at FROM ({PAIR_SQL})",
    "panel teams",
    "cor",
)
def b7(spark, d):
    years = D.panel(spark, d).agg(F.min("season").alias("min_year"), F.max("season").alias("max_year"))  # one row
    return correlations(spark, d).join(F.broadcast(years)).withColumn("created_at", F.lit("2024-01-01"))


_COR_SQL = f"SELECT relation, one AS position1, var1, other AS position2, var2, cor FROM ({PAIR_SQL}), LATERAL (SELECT unnest(string_split(position1, '|')) AS one), LATERAL (SELECT unnest(string_split(position2, '|')) AS other)"


@query(
    "j13_correlation_lookup",
    f"WITH cor AS MATERIALIZED ({_COR_SQL}), cls AS (SELECT DISTINCT season, week, game, team, opponent, position, var FROM ({POOL_SQL})) "
    "SELECT p.relation, p.position1, p.var1, p.position2, p.var2, n, coalesce(cor, 0) AS cor FROM (SELECT CASE WHEN a.team = b.team THEN 'same_team' ELSE 'opp_team' END AS relation, a.position AS position1, a.var AS var1, b.position AS position2, b.var AS var2, count(*) AS n "
    "FROM cls a JOIN cls b ON a.season = b.season AND a.week = b.week AND a.game = b.game WHERE a.team = b.team OR a.opponent = b.team GROUP BY ALL) p LEFT JOIN cor USING (relation, position1, var1, position2, var2)",
    "panel teams bets",
    "cor",
)
def j13(spark, d):
    return R.correlation_lookup(pool(spark, d), coefs(spark, d), WEEK)


def _pair_sql(pool_sql: str, x: str) -> str:
    return (
        f"WITH cor AS MATERIALIZED ({_COR_SQL}), pl AS MATERIALIZED ({pool_sql}), pr AS MATERIALIZED (SELECT a.season, a.week, a.game, CASE WHEN a.label = b.label AND a.var = b.var THEN 'same_label_and_type' WHEN a.label = b.label THEN 'same_label' WHEN a.team = b.team THEN 'same_team' ELSE 'opp_team' END AS relation, "
        f"a.position AS position1, a.var AS var1, b.position AS position2, b.var AS var2, a.{x} * b.{x} AS xx FROM pl a JOIN pl b ON a.season = b.season AND a.week = b.week AND a.game = b.game AND a.bet_id < b.bet_id) "
        "SELECT season, week, game, relation, count(*) AS n_pairs, sum(xx * CASE WHEN relation = 'same_label_and_type' THEN 1.0 ELSE coalesce(cor, 0.0) END) AS cov_sum FROM ("
        "SELECT pr.*, cor.cor FROM pr LEFT JOIN cor ON cor.relation = CASE pr.relation WHEN 'same_label' THEN 'same_player' ELSE pr.relation END AND cor.position1 = pr.position1 AND cor.var1 = pr.var1 AND cor.position2 = pr.position2 AND cor.var2 = pr.var2) GROUP BY ALL"
    )


@query(
    "b8_covariance_pairs",
    _pair_sql(f"SELECT *, sqrt(risk_score) AS sd FROM ({POOL_SQL})", "sd"),
    "panel teams bets",
    "cov_sum",
)
def b8(spark, d):
    with_sd = pool(spark, d).withColumn("sd", F.sqrt("risk_score"))
    return R.pair_covariance(with_sd, coefs(spark, d), WEEK, "sd")


@query("b9_repaired_blocks")
def b9(spark, d):
    return R.game_blocks(pool(spark, d), R.coefficient_map(coefs(spark, d)), WEEK)


@query("b10_weight_sweep")
def b10(spark, d):
    return R.weight_sweep(pool(spark, d), R.coefficient_map(coefs(spark, d)), WEEK, R.gamma_grid())


def given_weights(spark, d):
    """Three simple portfolios per week: the 4, 8 and 12 best bets, weighted by value."""
    ranked = W.top_n(pool(spark, d), WEEK, [F.desc("ev"), "bet_id"], 12, rank="rank")
    each = ranked.select("*", F.explode(F.array(F.lit(4), F.lit(8), F.lit(12))).alias("portfolio_id")).where("rank <= portfolio_id")
    return staged(W.share_of_group(each, [*WEEK, "portfolio_id"], "ev", "weight"), "given")  # metrics read it twice


_WEIGHTS_SQL = (
    f"SELECT *, ev / sum(ev) OVER (PARTITION BY season, week, portfolio_id) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY season, week ORDER BY ev DESC, bet_id) AS rank FROM ({POOL_SQL})), (SELECT unnest([4, 8, 12]) AS portfolio_id) WHERE rank <= portfolio_id"
)
_METRICS_SQL = (
    f"SELECT season, week, portfolio_id, mu AS portfolio_mu, diag + 2 * coalesce(cov, 0) AS portfolio_var, sqrt(greatest(diag + 2 * coalesce(cov, 0), 0)) AS portfolio_sd, mu / nullif(sqrt(greatest(diag + 2 * coalesce(cov, 0), 0)), 0) AS portfolio_sharpe FROM ("
    f"WITH cor AS MATERIALIZED ({_COR_SQL}), wt AS MATERIALIZED (SELECT *, weight * sqrt(risk_score) AS x FROM ({_WEIGHTS_SQL})), pr AS MATERIALIZED (SELECT a.season, a.week, a.portfolio_id, CASE WHEN a.label = b.label AND a.var = b.var THEN 'twin' WHEN a.label = b.label THEN 'same_player' WHEN a.team = b.team THEN 'same_team' ELSE 'opp_team' END AS relation, "
    "a.position AS position1, a.var AS var1, b.position AS position2, b.var AS var2, a.x * b.x AS xx FROM wt a JOIN wt b ON a.season = b.season AND a.week = b.week AND a.portfolio_id = b.portfolio_id AND a.game = b.game AND a.bet_id < b.bet_id), "
    "cv AS (SELECT season, week, portfolio_id, sum(xx * CASE WHEN relation = 'twin' THEN 1.0 ELSE coalesce(cor, 0.0) END) AS cov FROM pr LEFT JOIN cor USING (relation, position1, var1, position2, var2) GROUP BY ALL) "
    "SELECT wt.season, wt.week, wt.portfolio_id, sum(weight * ev / 100.0) AS mu, sum(x * x) AS diag, any_value(cov) AS cov FROM wt LEFT JOIN cv ON cv.season = wt.season AND cv.week = wt.week AND cv.portfolio_id = wt.portfolio_id GROUP BY ALL)"
)


@query("b11_portfolio_metrics", _METRICS_SQL, "panel teams bets", "portfolio_mu portfolio_var portfolio_sd portfolio_sharpe")
def b11(spark, d):
    return R.portfolio_metrics(given_weights(spark, d), coefs(spark, d), [*WEEK, "portfolio_id"])


@query(
    "b12_best_portfolio",
    f"SELECT 'sharpe' AS rule, season, week, portfolio_id, round(portfolio_mu, 9) AS portfolio_mu, portfolio_sd FROM ({_METRICS_SQL}) WHERE portfolio_sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season, week ORDER BY round(portfolio_sharpe, 9) DESC, portfolio_id) = 1 "
    f"UNION ALL SELECT 'capped', season, week, portfolio_id, round(portfolio_mu, 9), portfolio_sd FROM ({_METRICS_SQL}) WHERE portfolio_sd < 1.0 QUALIFY row_number() OVER (PARTITION BY season, week ORDER BY round(portfolio_mu, 9) DESC, portfolio_id) = 1",
    "panel teams bets",
    "portfolio_mu portfolio_sd",
)
def b12(spark, d):
    metrics = staged(b11(spark, d), "metrics").withColumns({
        "portfolio_mu": F.round("portfolio_mu", 9), "portfolio_sharpe": F.round("portfolio_sharpe", 9)
    })
    keep = ["season", "week", "portfolio_id", "portfolio_mu", "portfolio_sd"]
    sharpe = R.best_portfolio(metrics, WEEK, "portfolio_id").select(F.lit("sharpe").alias("rule"), *keep)
    capped = R.best_portfolio(metrics, WEEK, "portfolio_id", sd_cap=1.0).select(F.lit("capped").alias("rule"), *keep)
    return sharpe.unionByName(capped)


@query(
    "b13_stakes",
    f"SELECT season, week, portfolio_id, bet_id, weight / sum(weight) OVER (PARTITION BY season, week, portfolio_id) AS weight, 50.0 * weight / sum(weight) OVER (PARTITION BY season, week, portfolio_id) AS bet_amount FROM ({_WEIGHTS_SQL}) WHERE 50.0 * weight > 3.0",
    "bets",
    "weight bet_amount",
)
def b13(spark, d):
    staked = R.stakes(given_weights(spark, d), [*WEEK, "portfolio_id"], 50.0, 3.0)
    return staked.select("season", "week", "portfolio_id", "bet_id", "weight", "bet_amount")


# --- the same three steps over every bet of a week -------------------------------------------

TILTS = [0.0, 0.25, 0.5, 0.75, 1.0]
_TILTED_SQL = (
    "SELECT *, score / sum(score) OVER (PARTITION BY season, week, portfolio_id) AS weight FROM (SELECT pl.*, portfolio_id, ev / pow(risk_score, tilt) AS score "
    f"FROM ({POOL_SQL}) pl, (VALUES {', '.join(f'({i}, {t}::DOUBLE)' for i, t in enumerate(TILTS))}) t(portfolio_id, tilt) WHERE ev > 0 AND risk_score > 0)"
)
_ALL_METRICS_SQL = _METRICS_SQL.replace(_WEIGHTS_SQL, _TILTED_SQL)


METRIC_COLUMNS = [*WEEK, "game", "team", "opponent", "position", "label", "var", "ev", "risk_score"]


def tilted(spark, d, columns):
    """Every bet once per tilt, with the columns its reader needs."""
    return staged(R.tilted_weights(pool(spark, d).select(*columns), WEEK, TILTS), "tilted")


@query("b11_metrics_of_all_bets", _ALL_METRICS_SQL, "panel teams bets", "portfolio_mu portfolio_var portfolio_sd portfolio_sharpe")
def b11_all(spark, d):
    return R.portfolio_metrics(tilted(spark, d, METRIC_COLUMNS), coefs(spark, d), [*WEEK, "portfolio_id"])


@query(
    "b12_best_of_all_bets",
    f"WITH m AS MATERIALIZED ({_ALL_METRICS_SQL}) SELECT season, week, portfolio_id, portfolio_mu, portfolio_sd FROM m WHERE portfolio_sharpe IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY season, week ORDER BY round(portfolio_sharpe, 9) DESC, portfolio_id) = 1",
    "panel teams bets",
    "portfolio_mu portfolio_sd",
)
def b12_all(spark, d):
    metrics = staged(b11_all(spark, d), "metrics").withColumn("portfolio_sharpe", F.round("portfolio_sharpe", 9))
    return R.best_portfolio(metrics, WEEK, "portfolio_id").select("season", "week", "portfolio_id", "portfolio_mu", "portfolio_sd")


@query(
    "b13_stakes_on_all_bets",
    f"SELECT season, week, portfolio_id, bet_id, weight / sum(weight) OVER (PARTITION BY season, week, portfolio_id) AS weight, 1000.0 * weight / sum(weight) OVER (PARTITION BY season, week, portfolio_id) AS bet_amount FROM ({_TILTED_SQL}) WHERE 1000.0 * weight > 1.0",
    "bets",
    "weight bet_amount",
)
def b13_all(spark, d):
    return R.stakes(tilted(spark, d, [*WEEK, "bet_id", "ev", "risk_score"]), [*WEEK, "portfolio_id"], 1000.0, 1.0).select("season", "week", "portfolio_id", "bet_id", "weight", "bet_amount")


@query("e3_bets_to_stakes")
def e3(spark, d):
    """From priced predictions to stakes: screen, value, covariance, weights, choice."""
    from ..api import bets_with_value, portfolios

    bets = D.bets(spark, d).where("team <> opponent")
    once = W.latest_per_key(bets.withColumn("label", F.concat("label", F.lit("@"), "team")), [*WEEK, "label", "response_var"], ["bet_id"])
    valued = bets_with_value(once).select(
        "season", "week", "bet_id", "label", F.when(F.col("position") == "team", "Team").otherwise(F.col("position")).alias("position"),
        "team", "opponent", V.choose("type", VARS, F.col("type")).alias("var"),
        "ev", "risk_score", C.pair_key("team", "opponent").alias("game"),
    )
    out = portfolios(valued, coefs(spark, d), bank=50.0, sd_cap=3.0, max_bets=10)
    return out.select("season", "week", "portfolio_id", "bet_id", "weight", "bet_amount", "portfolio_sd")
