"""Comparison of scored models and the staged choice among them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.aggregates import calibration_score, log_loss, reliability_table
from ..operators.windows import top_n, within_best

# Limits of the candidates and tolerances of the stages.
MAX_CALIBRATION, MAX_BAD = 0.06, 0.3
TOLERANCE = {"calibration_score": 0.01, "pct_bad": 0.05, "range_calibrations": 0.02, "improvement": 0.02}

# Tiers from best to worst; (metric, cutoff, higher is better).
TIERS = [
    ("Extra Strong", [("improvement", 0.25, True), ("calibration_score", 0.01, False), ("range_calibrations", 0.01, False), ("pct_bad", 0.05, False)]),
    ("Strong", [("improvement", 0.15, True), ("calibration_score", 0.02, False), ("range_calibrations", 0.01, False), ("pct_bad", 0.25, False)]),
    ("Medium", [("improvement", 0.05, True), ("calibration_score", 0.03, False), ("range_calibrations", 0.03, False), ("pct_bad", 0.25, False)]),
]
LAST_TIER = "Weakest"

RANGES = {"under_30": (None, 0.3), "30_to_60": (0.3, 0.6), "above_60": (0.6, None)}


def ensemble(scores: DataFrame, row: Sequence[str], name: str, members: Sequence[str] | None = None) -> DataFrame:
    """Mean score of some or all models per row."""
    chosen = scores.where(F.col("model_type").isin(*members)) if members else scores
    return chosen.groupBy(*row).agg(F.avg("p").alias("p")).withColumn("model_type", F.lit(name))


def comparison_table(scores: DataFrame, keys: Sequence[str], p: str = "p", hit: str = "bet_hit") -> DataFrame:
    """Calibration overall and by probability range, log loss and verdict counts per model."""
    band = F.when(F.col(p) < 0.3, "under_30").when(F.col(p) < 0.6, "30_to_60").otherwise("above_60")
    rel = reliability_table(scores, p, hit, keys)
    overall = calibration_score(rel, keys)
    by_range = calibration_score(reliability_table(scores.withColumn("_range", band), p, hit, [*keys, "_range"]), [*keys, "_range"])
    # pivot of three fixed ranges as conditional aggregates: one shuffle
    wide = by_range.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_range") == r, F.col("calibration_score"))).alias(f"calibration_score_{r}") for r in RANGES]
    )
    counts = rel.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("assessment") == v, F.col("n"))), F.lit(0)).alias(n)
        for n, v in (("num_inside_range", "Inside Target Range"), ("num_near_range", "Near Target Range"), ("num_bad", "Bad"))
    ])
    loss = scores.groupBy(*keys).agg(F.avg(log_loss(p, hit)).alias("validation_log_loss"))
    on = list(keys)
    return loss.join(overall, on, "left").join(wide, on, "left").join(counts, on, "left")


def with_gain(comparison: DataFrame, baseline: DataFrame) -> DataFrame:
    """Gain over the baseline loss, share of bad bins, spread over ranges."""
    ranges = [f"calibration_score_{r}" for r in RANGES]
    known = F.col("num_bad") + F.col("num_inside_range") + F.col("num_near_range")
    available = F.lit(0)
    for r in ranges:
        available = available + F.col(r).isNotNull().cast("int")
    return comparison.join(baseline.select("response_var", "baseline_log_loss"), "response_var", "left").select(
        "*",
        F.try_divide(F.col("baseline_log_loss") - F.col("validation_log_loss"), F.col("baseline_log_loss")).alias("improvement"),
        F.try_divide("num_bad", known).alias("pct_bad"),
        (F.greatest(*ranges) - F.least(*ranges)).alias("range_calibrations"),
        available.cast("bigint").alias("ranges_available"),
    )


def survivors(gained: DataFrame) -> DataFrame:
    return gained.where((F.col("calibration_score") <= MAX_CALIBRATION) & (F.col("pct_bad") <= MAX_BAD) & (F.col("improvement") > 0))


def select_best(candidates: DataFrame, target: str = "response_var") -> DataFrame:
    """One model per target by stages; a stage is skipped once one candidate is left."""
    out = within_best(candidates, [target], "calibration_score", TOLERANCE["calibration_score"])
    out = within_best(out, [target], "pct_bad", TOLERANCE["pct_bad"])
    out = within_best(out, [target], "range_calibrations", TOLERANCE["range_calibrations"])
    out = within_best(out, [target], "improvement", TOLERANCE["improvement"], higher=True)
    out = within_best(out, [target], "ranges_available", 0, higher=True)
    w = Window.partitionBy(target)
    score = F.lit(0.0)
    for metric, tolerance in TOLERANCE.items():
        gap = F.max(metric).over(w) - F.col(metric) if metric == "improvement" else F.col(metric) - F.min(metric).over(w)
        score = score + gap / tolerance
    scored = out.withColumn("tie_break_score", score)
    order = [F.col("tie_break_score").asc_nulls_last(), F.col("model_type"), F.col("extra_calibration")]
    return top_n(scored, [target], order, 1)


def tier() -> Column:
    """Best tier whose criteria all hold, or all but one with that one near."""
    out: Column | None = None
    for name, criteria in TIERS:
        strict, near = F.lit(0), F.lit(True)
        for metric, cutoff, higher in criteria:
            v, slack = F.col(metric), TOLERANCE[metric] + 1e-4
            strict = strict + F.coalesce((v >= cutoff) if higher else (v <= cutoff), F.lit(False)).cast("int")
            near = near & F.coalesce((v >= cutoff - slack) if higher else (v <= cutoff + slack), F.lit(False))
        reached = (strict == 4) | ((strict == 3) & near)
        out = F.when(reached, name) if out is None else out.when(reached, name)
    return out.otherwise(LAST_TIER)


def chosen_bins(chosen: DataFrame, scores: DataFrame) -> DataFrame:
    """Reliability bins of each chosen model."""
    keys = ["response_var", "model_type", "extra_calibration"]
    mine = scores.join(chosen.select(*keys, "model_assessment"), keys)
    return reliability_table(mine, "p", "bet_hit", [*keys, "model_assessment"])
