"""Projections and schema operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class FeatureRegistry:
    """Which columns belong to which feature group; metadata only."""

    groups: dict[str, list[str]] = field(default_factory=dict)

    def add(self, group: str, columns: Iterable[str]) -> None:
        known = self.groups.setdefault(group, [])
        known.extend(c for c in columns if c not in known)

    def columns(self, *groups: str) -> list[str]:
        return [c for g in groups for c in self.groups.get(g, [])]

    def tag(self, df: DataFrame) -> DataFrame:
        """Write the group of each column into its field metadata."""
        owner = {c: g for g, cs in self.groups.items() for c in cs}
        return df.select(
            *[F.col(c).alias(c, metadata={"group": owner[c]}) if c in owner else F.col(c) for c in df.columns]
        )


def team_rows(games: DataFrame) -> DataFrame:
    """One game row to two team rows with mirrored scores; one scan, no union."""

    def side(me: str, other: str) -> Column:
        return F.struct(
            F.lit(me).alias("venue"),
            F.col(me).alias("team"),
            F.col(other).alias("opponent"),
            F.col(f"{me}_score").alias("team_score"),
            F.col(f"{other}_score").alias("opponent_score"),
        )

    return games.select(
        "game_id", "season", "week", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")
    ).select("game_id", "season", "week", "s.*")


def mirror_columns(df: DataFrame, keys: Mapping[str, str], forced: Sequence[str], neutral: Sequence[str], prefix: str = "opp_defense_") -> DataFrame:
    """Rename one side's measures as what the other side allowed or forced."""
    out = [F.col(k).alias(v) for k, v in keys.items()]
    for c in df.columns:
        if c in keys:
            continue
        suffix = "_forced" if c in forced else "" if c in neutral else "_allowed"
        out.append(F.col(c).alias(prefix + c + suffix))
    return df.select(*out)


def finite_only(df: DataFrame) -> DataFrame:
    """Infinities and NaN to NULL in every floating column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def default_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def zero_if_took_part(df: DataFrame, cols: Sequence[str], share: str, since: Mapping[str, int] | None = None, season: str = "season") -> DataFrame:
    """NULL becomes 0 only where the entity took part, for some columns only from a season on."""
    out = {}
    for c in cols:
        here = (F.col(share) > 0) & F.col(c).isNull()
        if since and c in since:
            here = here & (F.col(season) >= since[c])
        out[c] = F.when(here, 0.0).otherwise(F.col(c))
    return df.withColumns(out)


def blank_targets(df: DataFrame, cols: Sequence[str], predicted: Column) -> DataFrame:
    return df.withColumns({c: F.when(~predicted, F.col(c)) for c in cols})


def target_family(df: DataFrame, registry: FeatureRegistry, groups: Sequence[str], keys: Sequence[str], position: str, positions: Sequence[str]) -> DataFrame:
    """Rows and columns of one target family."""
    return df.where(F.col(position).isin(*positions)).select(*keys, *registry.columns(*groups))


def align_schema(df: DataFrame, schema: T.StructType, levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Columns, order and types of ``schema``; unknown category levels become NULL."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            c = F.lit(None).cast(f.dataType)
        else:
            c = F.col(f.name).try_cast(f.dataType)
        if levels and f.name in levels:
            c = F.when(c.isin(*levels[f.name]), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def informative_columns(df: DataFrame, cols: Sequence[str], missing_threshold: float) -> DataFrame:
    """One verdict row per column: drop, zero_one, low_median or keep.

    Columns become rows first, so the plan after that is the same for
    ten columns and for thousands; the medians come from counting passes over those rows, not from a sort.
    """
    from ..sources.tables import staged
    from .quantiles import keyed_percentiles

    stacked = staged(df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    ).select("s.name", "s.v"), "stacked")
    medians = keyed_percentiles(stacked, [0.5], key="name").select("name", F.col("edges")[0].alias("_middle"))
    # distinct values are counted partially in each task
    per_value = stacked.groupBy("name", "v").agg(F.count("*").alias("k"))
    found = per_value.groupBy("name").agg(
        F.sum("k").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("present"),
        F.count("v").alias("distinct_values"),
        F.coalesce(F.bool_and(F.when(F.col("v").isNotNull(), F.col("v").isin(0.0, 1.0))), F.lit(False)).alias("zero_one"),
        F.try_divide(F.sum(F.col("v") * F.col("k")), F.sum(F.when(F.col("v").isNotNull(), F.col("k")))).alias("mean"),
    )
    middle = F.col("_middle")
    usable = (F.col("present") / F.col("rows") > 1 - missing_threshold) & (F.col("distinct_values") > 1)
    verdict = (
        F.when(~usable, "drop")
        .when(F.col("zero_one"), "zero_one")
        .when((middle == 0) & (F.col("mean") < 1) & (F.col("distinct_values") < 10), "low_median")
        .otherwise("keep")
    )
    return found.join(medians, "name", "left").select("name", "rows", "present", "distinct_values", "mean", middle.alias("median"), verdict.alias("verdict"))
