"""The three entry points of a betting week: score, value, allocate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as C
from .models.training import score_targets
from .operators import portfolio as R
from .operators import value as V
from .sources.tables import staged

WEEK = ("season", "week")
PORTFOLIO_COLUMNS = ["season", "week", "bet_id", "game", "label", "position", "team", "opponent", "var", "ev", "risk_score"]


def predict(rows: DataFrame, model_paths: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Model probability of each row by the chosen model of its target."""
    return score_targets(rows, model_paths, keys)


def bets_with_value(
    bets: DataFrame, model_tiers: DataFrame | None = None, positive_only: bool = True, caps: bool = True, week: Sequence[str] = WEEK,
) -> DataFrame:
    """Bets whose ladder is plausible, with expected value and risk.

    One bet per week, label and target.
    """
    rungs = bets.withColumns({"root": C.ladder_root("response_var"), "number": C.ladder_number("response_var")})
    screened = V.without_ladder_violations(rungs, [*week, "label", "root"]).drop("root", "number")
    return V.expected_value_and_risk(screened, caps=caps, positive_only=positive_only, model_tiers=model_tiers)


def correlations_for_season(table: DataFrame, season: int) -> DataFrame:
    """Newest coefficient table made from the seasons before; an error when there is none."""
    usable = table.where(F.col("max_year") == season - 1)
    newest = usable.agg(F.max("created_at")).first()[0]
    if newest is None:
        raise ValueError(f"no correlations through {season - 1}")
    return R.coefficients(usable.where(F.col("created_at") == newest))


def portfolios(
    valued: DataFrame, correlations: DataFrame, bank: float, sd_cap: float, min_stake: float = 0.5, max_bets: int | None = None,
    gammas: Sequence[float] | None = None, week: Sequence[str] = WEEK,
) -> DataFrame:
    """Stakes of the portfolio with the highest mean below the deviation cap, per week."""
    missing = [c for c in PORTFOLIO_COLUMNS if c not in valued.columns]
    if missing:
        raise ValueError(f"bets lack the columns {', '.join(missing)}")
    pool = staged(valued.select(*PORTFOLIO_COLUMNS), "pool")
    coefs = staged(correlations, "coefficients")
    weights = R.weight_sweep(pool, R.coefficient_map(coefs), week, gammas or R.gamma_grid(), max_bets)
    weighted = staged(weights.join(pool, [*week, "bet_id"]), "weights")
    portfolio = [*week, "portfolio_id"]
    metrics = R.portfolio_metrics(weighted, coefs, portfolio)
    best = R.best_portfolio(metrics, week, "portfolio_id", sd_cap=sd_cap)
    chosen = weighted.join(best, portfolio)
    return R.stakes(chosen, portfolio, bank, min_stake)
