"""Prior-history windows over entity-period panels.

A panel has one row per entity and period; build it with a ``groupBy`` first.
Periods per entity are few (weeks of a season, seasons of a career), so a window
partition stays small however many raw rows an entity has.
Every window here ends one row before the current row: nothing leaks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

Keys = Sequence[str]


def prior(by: Keys, order: Keys, last: int | None = None) -> WindowSpec:
    """All earlier rows, or the ``last`` n earlier rows, of the same entity."""
    start = Window.unboundedPreceding if last is None else -last
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(start, -1)


def _statistics(c: str, prefix: str, w: WindowSpec, ready: Column, sums_only: bool) -> list[Column]:
    total = F.when(ready, F.coalesce(F.sum(c).over(w), F.lit(0.0))).alias(f"{prefix}cumulative_{c}")
    if sums_only:
        return [total]
    mean, sd = F.avg(c).over(w), F.stddev_samp(c).over(w)
    named = {
        "avg": mean,
        "median": F.percentile(c, F.lit(0.5)).over(w),
        "min": F.min(c).over(w),
        "max": F.max(c).over(w),
        "sd": sd,
        "cv": F.try_divide(sd, mean),
    }
    return [total] + [F.when(ready, e).alias(f"{prefix}{k}_{c}") for k, e in named.items()]


def prior_stats(
    df: DataFrame, by: Keys, order: Keys, cols: Keys, last: int = 3, sums_only: bool = False
) -> DataFrame:
    """Expanding and trailing statistics of earlier rows.

    The trailing ones stay NULL until ``last`` earlier rows exist.  A window that
    holds only NULLs sums to 0; an empty one gives NULL.
    """
    whole, recent = prior(by, order), prior(by, order, last)
    some = F.count(F.lit(1)).over(whole) > 0
    full = F.count(F.lit(1)).over(recent) == last
    out: list[Column] = []
    for c in cols:
        out += _statistics(c, "", whole, some, sums_only)
        out += _statistics(c, f"last{last}_", recent, full, sums_only)
    return df.select("*", *out)


def lags(df: DataFrame, by: Keys, order: Keys, cols: Keys, steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag{n}") for c in cols for n in steps])


def ordinal(by: Keys, order: Keys) -> Column:
    """How many earlier rows the group has."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("bigint") - 1


def run_length(df: DataFrame, by: Keys, order: Keys, value: str, name: str) -> DataFrame:
    """Position inside the current unbroken run of ``value``, starting at 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = df.withColumn("_start", starts).withColumn(
        "_island", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    inside = Window.partitionBy(*by, "_island").orderBy(*order)
    return marked.withColumn(name, F.row_number().over(inside).cast("bigint")).drop("_start", "_island")


def change_flags(df: DataFrame, entity: str, season: str, order: Keys, value: str) -> DataFrame:
    """Arrived during the season; first season with the present value."""
    w = Window.partitionBy(entity, season).orderBy(*order)
    before = F.lag(value).over(w)
    first = F.min(season).over(Window.partitionBy(entity, value))
    return df.select(
        "*",
        (before.isNotNull() & (before != F.col(value))).alias("arrived_mid_season"),
        (F.col(season) == first).alias("first_season_with_team"),
    )


def latest_per_key(df: DataFrame, keys: Keys, newest: Sequence[Column | str]) -> DataFrame:
    """One row per key: the greatest by ``newest``.

    An aggregate, not a window: every task first keeps one row per key, so a key
    with very many snapshots sends one row per task. The rows of a task are sorted by key first, since the payload is a struct.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in newest])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def groups_seen(df: DataFrame, entity: str, order: Keys, value: str, name: str) -> DataFrame:
    """How many different values the entity has had so far, this row included."""
    first = F.row_number().over(Window.partitionBy(entity, value).orderBy(*order)) == 1
    running = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_first", first.cast("bigint"))
        .withColumn(name, F.sum("_first").over(running))
        .drop("_first")
    )


def fill_down(c: str, by: Keys, order: Keys) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(c, ignorenulls=True).over(w)


def share_of_group(df: DataFrame, keys: Keys, value: str, name: str) -> DataFrame:
    """Value over the group's total; the totals are aggregated first and joined back."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(keys)).withColumn(name, F.try_divide(value, "_total")).drop("_total")


def matchup_ratio(
    df: DataFrame, entity: Keys, opponent: str, order: Keys, value: str, weight: int, name: str, last: int | None = None
) -> DataFrame:
    """Mean against this opponent, pulled to the overall mean, over the overall mean.

    The first meeting has no earlier game and gives NULL.
    """
    overall = F.avg(value).over(prior(entity, order, last))
    facing = prior([*entity, opponent], order, last)
    met = F.count(F.lit(1)).over(facing)
    blended = (F.avg(value).over(facing) * met + overall * weight) / (met + weight)
    return df.withColumn(name, F.try_divide(blended, overall))


def ladder_violations(
    df: DataFrame, keys: Keys, number: str, probability: str, tolerance: float
) -> DataFrame:
    """Flag rungs whose probability exceeds the rung below by more than the tolerance."""
    below = F.lag(probability).over(Window.partitionBy(*keys).orderBy(number))
    return df.withColumn("previous_probability", below).withColumn(
        "violates",
        F.coalesce(F.col(probability) > F.col("previous_probability") + tolerance, F.lit(False)),
    )


def top_n(df: DataFrame, keys: Keys, order: Sequence[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group; Spark limits each group inside every task before the shuffle."""
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def within_best(
    df: DataFrame, keys: Keys, metric: str, tolerance: float, higher: bool = False
) -> DataFrame:
    """Keep rows within a tolerance of the group's best; a group of one row is kept as it is."""
    w = Window.partitionBy(*keys)
    best = (F.max if higher else F.min)(metric).over(w)
    inside = (
        F.col(metric) >= best - tolerance if higher else F.col(metric) <= best + tolerance
    )
    alone = F.count(F.lit(1)).over(w) == 1
    return df.withColumn("_keep", alone | inside).where("_keep").drop("_keep")


def active_windows(ends: DataFrame, by: Keys, order: str, end: str, default_start: Column) -> DataFrame:
    """Start of each period: one second after the previous period of the group ended."""
    w = Window.partitionBy(*by).orderBy(order)
    previous = F.lag(end).over(w)
    start = F.coalesce(previous + F.expr("INTERVAL 1 SECOND"), default_start)
    return ends.withColumn("week_start", start)
