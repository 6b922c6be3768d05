"""From probabilities and odds to value, settlement and return reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from .aggregates import return_rollup, settle
from .windows import ladder_violations, latest_per_key, top_n

# Largest expected value per 100 that is believed, by bet type.
EV_CAPS = {
    "team_differential": 20,
    "team_win": 30,
    "passing_yards": 150,
    "receiving_yards": 250,
    "receptions": 500,
    "rushing_yards": 250,
    "rushing_receiving_yards": 250,
    "anytime_td_scorer": 250,
}

# Risk multipliers by model tier and by verdict on the probability bin.
MODEL_PENALTY = {"Extra Strong": 1.0, "Strong": 1.5, "Medium": 2.0}
MODEL_PENALTY_OTHER = 3.0
BIN_PENALTY = {"Inside Target Range": 1.0, "Near Target Range": 1.5, "Bad": 3.0}
BIN_PENALTY_OTHER = 2.0

# Share of the bank by group of game days (Sunday is day 1).
DAY_GROUPS = {1: "sunday", 2: "monday", 4: "thursday", 5: "thursday", 6: "thursday", 7: "sunday"}
DAY_FRACTIONS = {"thursday": 0.2, "sunday": 0.6, "monday": 0.2}


def choose(key: Column | str, values: Mapping[object, object], other: object = None) -> Column:
    """Lookup in a small fixed table; the key is read once however many entries there are."""
    k = F.col(key) if isinstance(key, str) else key
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    default = other if isinstance(other, Column) else F.lit(other)
    return F.coalesce(F.try_element_at(table, k), default)


def closing_lines(lines: DataFrame, keys: Sequence[str], run: str, start: str, minutes: int = 10, tie: str = "event_id") -> DataFrame:
    """Last line per market that was seen more than ``minutes`` before the start."""
    early = lines.where(F.col(run) < F.col(start) - F.expr(f"INTERVAL {minutes} MINUTES"))
    return latest_per_key(early, keys, [run, tie])


@dataclass(frozen=True)
class Family:
    """Target root of a market: without a rung the root is the code, with ``flip`` the rung is the points, sign changed."""

    root: str
    has_rung: bool = True
    flip: bool = False


def market_targets(lines: DataFrame, market: str, points: str, number: str, families: Mapping[str, Family], ladders: DataFrame) -> DataFrame:
    """Market to target code; only rungs of the known ladders stay."""
    root = choose(market, {m: f.root for m, f in families.items()})
    has_rung = choose(market, {m: f.has_rung for m, f in families.items()})
    flip = choose(market, {m: f.flip for m, f in families.items()})
    rung = F.when(flip, -F.col(points)).otherwise(F.col(number))
    coded = lines.withColumn("response_var", F.when(has_rung, C.ladder_code(root, rung)).otherwise(root))
    return coded.join(ladders.select("response_var"), "response_var", "left_semi")


def match_predictions(lines: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines with the newest prediction, of players or teams, of the same target, name and day."""
    joined = lines.join(predictions, list(keys), "left")
    return joined.withColumn("implied_probability", C.implied_probability("odds"))


def still_open(matched: DataFrame, start: str, now: Column, hours: int = 1) -> DataFrame:
    """Games count as open until ``hours`` after their start; an unknown start stays."""
    return matched.where(F.col(start).isNull() | (F.col(start) > now - F.expr(f"INTERVAL {hours} HOURS")))


def unmatched_labels(matched: DataFrame, label: str, probability: str) -> DataFrame:
    """Labels of which no line found a prediction."""
    return matched.groupBy(label).agg(F.count(probability).alias("_hits"), F.count("*").alias("lines")).where("_hits = 0").drop("_hits")


def bet_won(kind: Column | str, number: Column | str, measure: Column | str) -> Column:
    """A spread must be beaten; every other rung must be reached."""
    k, n, m = (F.col(x) if isinstance(x, str) else x for x in (kind, number, measure))
    return F.coalesce(
        F.when(k == "anytime_td_scorer", m > 0).when(k == "team_win", m > 0).when(k == "team_differential", m > n).otherwise(m >= n),
        F.lit(False),
    )


def expected_value_and_risk(
    bets: DataFrame, caps: bool = False, positive_only: bool = True,
    model_tiers: DataFrame | None = None, bin_verdicts: DataFrame | None = None,
) -> DataFrame:
    """Expected value and risk per bet, with optional caps, screens and penalties.

    ``model_tiers`` has (response_var, model_assessment); ``bin_verdicts`` has
    (response_var, probability_floor, assessment).
    """
    out = bets.select(
        "*",
        C.bet_type("response_var").alias("type"),
        C.profit_per_100("odds").alias("profit_per_100"),
        C.expected_value("p", "odds").alias("ev"),
        C.bet_risk("p", "odds").alias("risk_raw"),
    )
    if caps:
        out = out.where(F.col("ev") <= choose("type", EV_CAPS, float("inf")))
    if positive_only:
        out = out.where("ev > 0")
    score = F.col("risk_raw")
    if model_tiers is not None:
        out = out.join(model_tiers, "response_var", "left")
        score = score * choose("model_assessment", MODEL_PENALTY, MODEL_PENALTY_OTHER)
    if bin_verdicts is not None:
        out = C.with_probability_bin(out, "p").drop("probability_ceiling", "probability_range")
        verdicts = bin_verdicts.select("response_var", "probability_floor", F.col("assessment").alias("bin_assessment"))
        out = out.join(verdicts, ["response_var", "probability_floor"], "left")
        score = score * choose("bin_assessment", BIN_PENALTY, BIN_PENALTY_OTHER)
    return out.withColumn("risk_score", score).drop("model_assessment", "bin_assessment", "probability_floor")


def without_ladder_violations(rungs: DataFrame, keys: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Drop rungs that break the ladder; rows without a rung number stay."""
    ordered = ladder_violations(rungs.where("number IS NOT NULL"), keys, "number", "p", tolerance)
    kept = ordered.where(~F.col("violates")).drop("violates", "previous_probability")
    return kept.unionByName(rungs.where("number IS NULL"))


def straight_bets(bets: DataFrame, week: Sequence[str], max_n: int = 20, tie: str = "bet_id") -> DataFrame:
    """Returns of betting on the n best bets of each week, for all n at once.

    One ranking serves every n: a bet of rank r is part of the strategies r to ``max_n``.
    """
    ranked = top_n(bets, week, [F.desc("ev"), tie], max_n, rank="rank")
    each = ranked.withColumn("num_bets", F.explode(F.sequence(F.col("rank"), F.lit(max_n).cast("bigint"))))
    paid = settle(each, 100.0 / F.col("num_bets"))
    agg = paid.groupBy("num_bets").agg(
        F.sum("result_payout").alias("payout"), F.sum("amount").alias("spent"), F.percentile("odds", F.lit(0.5)).alias("median_odds")
    )
    return agg.select("num_bets", F.try_divide(F.col("payout") - F.col("spent"), F.col("spent")).alias("total_return"), "median_odds")


def _win_levels(settled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Wins from the most to the least profitable, equal ones counted together.

    A window over all wins of a strategy could be as large as the table.  Equal wins are
    interchangeable, so they are counted first; the wins before a level are those of
    the more profitable odds (few different values) and those of the same odds.
    """
    wins = settled.where("bet_hit").withColumn("profit", C.profit_per_100("odds"))
    levels = wins.groupBy(*by, "profit", "result_payout").agg(F.count("*").alias("wins"))
    odds = levels.groupBy(*by, "profit").agg(
        F.sum("wins").alias("_n"), F.sum(F.col("wins") * F.col("result_payout")).alias("_s")
    )
    more = Window.partitionBy(*by).orderBy(F.desc("profit")).rowsBetween(Window.unboundedPreceding, -1)
    odds = odds.select(
        *by, "profit", F.coalesce(F.sum("_n").over(more), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(more), F.lit(0.0)).alias("_s0")
    )
    same = Window.partitionBy(*by, "profit").orderBy(F.desc("result_payout")).rowsBetween(Window.unboundedPreceding, -1)
    inside = levels.select(
        *by, "profit", "result_payout", "wins",
        F.coalesce(F.sum("wins").over(same), F.lit(0)).alias("_n1"),
        F.coalesce(F.sum(F.col("wins") * F.col("result_payout")).over(same), F.lit(0.0)).alias("_s1"),
    )
    return inside.join(odds, [*by, "profit"]).select(
        *by, "result_payout", "wins", (F.col("_n0") + F.col("_n1")).alias("wins_before"), (F.col("_s0") + F.col("_s1")).alias("paid_before")
    )


def _baseline(settled: DataFrame, by: Sequence[str]) -> DataFrame:
    return settled.groupBy(*by).agg(
        F.sum("result_payout").alias("payout"), F.sum("amount").alias("spent"),
        F.count_if("bet_hit").alias("num_wins"), F.max("result_payout").alias("largest_win"),
    ).withColumn("baseline_return", F.try_divide(F.col("payout") - F.col("spent"), F.col("spent")))


def win_removal_stress(settled: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 2, 3, 5, 10), shares: Sequence[float] = (0.05, 0.10, 0.20, 0.30)) -> DataFrame:
    """Return once the k most profitable wins, or a share of them, are taken away."""
    base = _baseline(settled, by)
    cases = [F.struct(F.lit(f"top {k}").alias("scenario"), F.lit(k).cast("bigint").alias("k")) for k in ks]
    cases += [
        F.struct(F.lit(f"top {round(s * 100)}%").alias("scenario"), F.ceil(F.col("num_wins") * F.lit(s)).cast("bigint").alias("k"))
        for s in shares
    ]
    wanted = base.select("*", F.explode(F.array(*cases)).alias("c")).select(*base.columns, "c.*")
    levels = _win_levels(settled, by)
    taken = F.least(F.greatest(F.col("k") - F.col("wins_before"), F.lit(0)), F.col("wins")) * F.col("result_payout")
    # only levels that reach into the removed wins are matched
    reached = wanted.select(*by, "scenario", "k").join(levels, list(by)).where("wins_before < k")
    removed = reached.groupBy(*by, "scenario").agg(F.sum(taken).alias("removed"))
    out = wanted.join(removed, [*by, "scenario"], "left")
    adjusted = F.try_divide(F.col("payout") - F.coalesce("removed", F.lit(0.0)) - F.col("spent"), F.col("spent"))
    return out.select(
        *by, "scenario", F.col("k").alias("k_wins_removed"), "num_wins", "baseline_return", adjusted.alias("adjusted_return"),
        (F.col("baseline_return") - adjusted).alias("return_drop"),
        F.try_divide(adjusted, F.col("baseline_return")).alias("retained_share"),
    )


def wins_to_break_even(settled: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many of the most profitable wins may go before the return is zero or less."""
    base = _baseline(settled, by)
    surplus = base.select(*by, (F.col("payout") - F.col("spent")).alias("surplus"))
    levels = _win_levels(settled, by).join(surplus, list(by))
    missing = F.greatest(F.ceil((F.col("surplus") - F.col("paid_before")) / F.col("result_payout")), F.lit(1)).cast("bigint")
    reached = levels.where(F.col("paid_before") + F.col("wins") * F.col("result_payout") >= F.col("surplus"))
    first = reached.groupBy(*by).agg(F.min(F.col("wins_before") + missing).alias("wins_to_break_even"))
    return base.join(first, list(by), "left").select(
        *by, "baseline_return", "num_wins", "wins_to_break_even",
        F.try_divide(F.col("wins_to_break_even"), F.col("num_wins")).alias("share_to_break_even"),
        F.try_divide(F.col("payout") - F.col("largest_win") - F.col("spent"), F.col("spent")).alias("worst_single_removal"),
    )


def weekly_reliability(settled: DataFrame, strategy: Sequence[str], week: Sequence[str]) -> DataFrame:
    """Spread of the weekly returns of a strategy."""
    weekly = return_rollup(settled, [*strategy, *week])
    r = F.col("total_return")
    return weekly.groupBy(*strategy).agg(
        F.try_divide(F.sum("payout") - F.sum("spent"), F.sum("spent")).alias("season_return"),
        F.avg(r).alias("avg_weekly_return"),
        F.percentile(r, F.lit(0.5)).alias("median_weekly_return"),
        F.stddev_samp(r).alias("weekly_sd"),
        F.min(r).alias("min_week"),
        F.avg((r > 0).cast("double")).alias("pct_profitable_weeks"),
        F.avg((r <= -1).cast("double")).alias("pct_weeks_down_100"),
        F.count("*").alias("num_weeks"),
    )


def bankroll_split(bets: DataFrame, day: str, bank: float, by: Sequence[str]) -> DataFrame:
    """Stakes from a bank that is first divided among groups of game days.

    A week's bets of one day group share that group's part of the bank by weight.
    """
    grouped = bets.withColumn("day_group", choose(day, DAY_GROUPS)).where("day_group IS NOT NULL")
    totals = grouped.groupBy(*by, "day_group").agg(F.sum("weight").alias("_total"))
    share = F.try_divide("weight", "_total") * choose("day_group", DAY_FRACTIONS)
    return grouped.join(totals, [*by, "day_group"]).withColumn("portfolio_weight", share).withColumn(
        "amount", share * bank
    ).drop("_total")


def blanket_bets(bets: DataFrame, thresholds: Sequence[float | None]) -> DataFrame:
    """Spent, paid and return of placing every bet above each expected value; one scan."""
    rows = []
    paid = F.when(F.col("bet_hit"), C.profit_per_100("odds") + 100.0).otherwise(0.0)
    ev = C.expected_value("p", "odds")
    for i, t in enumerate(thresholds):
        chosen = F.lit(True) if t is None else ev > t
        rows += [F.count_if(chosen).alias(f"n{i}"), F.coalesce(F.sum(F.when(chosen, paid)), F.lit(0.0)).alias(f"p{i}")]
    one = bets.agg(*rows)
    names = ["all bets" if t is None else f"ev above {t:g}" for t in thresholds]
    stacked = one.select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("rule"), (F.col(f"n{i}") * 100.0).alias("spent"), F.col(f"p{i}").alias("payout"))
            for i, n in enumerate(names)
        ])).alias("r")
    ).select("r.*")
    return stacked.withColumn("total_return", F.try_divide(F.col("payout") - F.col("spent"), F.col("spent")))
