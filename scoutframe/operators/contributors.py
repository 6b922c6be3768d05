"""Key contributors of several families at once, each by its own metric, group result and limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import features as X
from . import windows as W
from .quantiles import keyed_percentiles

DIGITS = 12  # p-values and shares are compared after rounding, so that 1/10 is not above 0.1 by its last digit


@dataclass(frozen=True)
class Family:
    """Limits of one kind of contributor; ``side``: which way the group's result without the entity is tested."""

    name: str
    alpha: float
    min_share: float | None
    side: str = "greater"


# The reference's families, p-value limits and least shares
FAMILIES = (
    Family("passing", 0.1, None),
    Family("rushing", 0.15, 0.4),
    Family("receiving", 0.15, 0.2),
    Family("pass_rushers", 0.15, 0.2),
    Family("rush_tackles", 0.15, 0.2, "less"),
    Family("secondary", 0.15, 0.2, "less"),
)


def contributor_evidence(rows: DataFrame, families: Sequence[Family] = FAMILIES) -> DataFrame:
    """Per row the three-season metric, both p-values and the share, with nothing decided yet.

    ``rows``: family, entity, season, week, team, metric, group_metric, share; one row per family, entity and week, all
    families in one table, so every window and test runs once for all of them.  The entity counts as having played where it
    has a mean of this season's earlier weeks.  First side of the test: the group's results without the entity.
    """
    who, when = ["entity", "family"], ["season", "week"]  # numbers first: rows are sorted by them
    now = F.avg("metric").over(W.prior([*who, "season"], ["week"]))
    full = rows.withColumn("now", now).withColumn("games", W.ordinal([*who, "season"], ["week"]))
    for back, tag in ((1, "l"), (2, "b")):
        earlier = Window.partitionBy(*who).orderBy("season").rangeBetween(-back, -back)
        full = full.withColumn(f"{tag}_m", F.avg("metric").over(earlier)).withColumn(f"{tag}_g", F.count(F.lit(1)).over(earlier))

    def known(keys: Sequence[str], value: Column) -> Column:
        # rows without a key have neither earlier seasons nor a past
        return F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), value)

    full = full.withColumn("three", known([*who, "season"], X.weighted_three_seasons("now", "games", "l_m", "l_g", "b_m", "b_g")))
    full = full.withColumn("three", W.fill_down("three", [*who, "season"], ["week"]))
    kept = full.select(
        *who, *when, "team", "metric", "group_metric", F.round("share", DIGITS).alias("share"), "three", F.col("now").isNull().alias("without")
    )
    sides = {s: [f.name for f in families if f.side == s] for s in ("greater", "less")}
    side = F.when(F.col("family").isin(sides["less"]), "less").otherwise("greater")
    tested = X.played_or_not_test(kept, who, when, "group_metric", "without", side, keep_rows=True)
    p_play = F.when(F.col("family").isin([f.name for f in families]), F.round("p_value", DIGITS))
    tested = tested.select(*who, *when, "team", "metric", "three", "share", p_play.alias("p_play"))
    moved = X.former_groups_test(tested, who, when, "team", "metric", keep_rows=True)
    return moved.select(
        "family", "entity", *when, "team", F.col("three").alias("metric"), known([*who, *when], F.col("p_play")).alias("p_play"),
        known([*who, *when], F.round("changing_groups_p", DIGITS)).alias("p_move"), "share",
    )


def contributor_verdicts(rows: DataFrame, families: Sequence[Family] = FAMILIES, seasons_before: int = 2) -> DataFrame:
    """(entity, season, week, team, one flag per family): is the entity a key contributor of that family?

    Each family has its own 66th and 80th percentile of the three-season metric; a family that an entity is not in counts as
    false.  The first ``seasons_before`` seasons of ``rows`` have no such history and are left out.
    """
    spark = rows.sparkSession
    evidence = staged(contributor_evidence(rows, families), "evidence")
    edges = keyed_percentiles(evidence.select("family", "metric"), [0.66, 0.8], key="family", value="metric").select(
        "family", F.col("edges")[0].alias("low"), F.col("edges")[1].alias("high")
    )
    limits = spark.createDataFrame([(f.name, f.alpha, f.min_share) for f in families], "family string, alpha double, least double")
    known = evidence.join(limits, "family").join(edges, "family", "left")
    verdict = X.contributor_verdict("metric", "p_play", "p_move", "share", F.col("low"), F.col("high"), F.col("alpha"), F.col("least"))
    first = evidence.agg(F.min("season")).first()[0]
    flags = known.where(F.col("season") >= (first if first is not None else 0) + seasons_before).withColumn("verdict", verdict)
    return flags.groupBy("entity", "season", "week", "team").agg(
        *[F.coalesce(F.bool_or(F.when(F.col("family") == f.name, F.col("verdict"))), F.lit(False)).alias(f.name) for f in families]
    )
