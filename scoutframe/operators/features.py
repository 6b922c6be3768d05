"""Composite features: contributor tests, shares, workloads, targets and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as C
from . import ranks as R
from .quantiles import keyed_percentiles
from .windows import prior

Keys = Sequence[str]


# --- rank-sum tests ---------------------------------------------------------------------------


def rank_sum_tails(spark: SparkSession, below: int = R.EXACT_BELOW) -> DataFrame:
    """(n1, n2, tails): chance that U is at least 0, 1, ..., n1 * n2, for sides of 2 to ``below`` - 1 rows without ties.

    The table's size depends on ``below`` alone: 12 MB for 50.
    """
    found = R.chances_at_least(below)
    tails = pa.array(list(found.values()), pa.list_(pa.float64()))
    return spark.createDataFrame(pa.table({"n1": [k[0] for k in found], "n2": [k[1] for k in found], "tails": tails}))


def _by_career(df: DataFrame, entity: Keys, order: Keys, metric: str, more: Sequence[Column], compute, out: T.StructType) -> DataFrame:
    """``compute`` over tables of whole careers, each the rows of one entity in order, with their place ``__n`` and value ``__x``."""
    w = Window.partitionBy(*entity).orderBy(*order)
    rows = df.select("*", F.row_number().over(w).alias("__n"), F.dense_rank().over(w).alias("__period"), F.col(metric).cast("double").alias("__x"), *more)
    return rows.mapInArrow(R.over_careers(compute), out)


def played_or_not_test(
    df: DataFrame, entity: Keys, order: Keys, metric: str, played: str, side: str | Column = "greater", keep_rows: bool = False
) -> DataFrame:
    """Rank-sum test of a group's metric with and without the entity, over its earlier periods.

    ``side``: "greater" or "less", or a column of these words. Rows without a metric belong to no past; they are left out, or
    with ``keep_rows`` have NULL results.
    """
    columns = df.columns
    out = T.StructType([*df.schema.fields, *T.StructType.fromDDL("u double, n1 bigint, n2 bigint, z double, p_value double").fields])

    def compute(table: pa.Table) -> pa.Table:
        rows, career, x = R.careers(table)
        flag = table.column("__g").combine_chunks().take(pa.array(rows))
        found = R.played_or_not(career, x, flag.fill_null(False).to_numpy(zero_copy_only=False), flag.is_null().to_numpy(zero_copy_only=False))
        u, n1, n2 = (found[c] for c in ("u", "n1", "n2"))
        test = np.flatnonzero(found["known"] & (n1 > 1) & (n2 > 1))
        less = table.column("__less").to_numpy()[rows]
        untested, z, p = np.ones(len(rows), bool), np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        untested[test] = False
        z[test], p[test] = R.z_and_p(u[test], n1[test], n2[test], found["ties"][test], less[test])
        added = [(u, untested, pa.float64()), (n1, ~found["known"], pa.int64()), (n2, ~found["known"], pa.int64()), (z, np.isnan(z), pa.float64()), (p, np.isnan(p), pa.float64())]
        results = [R.column(values, missing, rows, len(table), kind) for values, missing, kind in added]
        return pa.Table.from_arrays([*(table.column(c) for c in columns), *results], names=out.names)

    less = side == "less" if isinstance(side, Column) else F.lit(side != "greater")
    more = [F.col(played).cast("boolean").alias("__g"), F.coalesce(less, F.lit(False)).alias("__less")]
    rows = df if keep_rows else df.where(F.col(metric).isNotNull())
    return _by_career(rows, entity, order, metric, more, compute, out)


def former_groups_test(
    df: DataFrame, entity: str | Keys, order: Keys, group: str, metric: str, side: str = "greater", keep_rows: bool = False
) -> DataFrame:
    """Smallest p-value over all pairs of the groups an entity has had before; the pair keeps
    the order in which the entity met its groups.

    One row per entity and period that has a test; with ``keep_rows`` every row of ``df``, with NULL results where there is none.
    """
    entity = [entity] if isinstance(entity, str) else list(entity)
    columns = df.columns if keep_rows else [*entity, *order]
    added = T.StructType.fromDDL("changing_groups_p double, largest_z double, pairs_tested bigint")
    out = T.StructType([*(df.schema[c] for c in columns), *added.fields])

    def compute(table: pa.Table) -> pa.Table:
        rows, career, x = R.careers(table)
        label = table.column("__k").combine_chunks().take(pa.array(rows)).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
        found = R.former_groups(career, x, label, side != "greater")
        # rows of one entity and period are one
        period = table.column("__period").to_numpy()[rows]
        first = np.flatnonzero(np.append(True, (career[1:] != career[:-1]) | (period[1:] != period[:-1]))[: len(rows)])
        least, largest, tests = (how.reduceat(found[c], first) if len(first) else found[c] for c, how in (("p", np.minimum), ("z", np.maximum), ("tests", np.add)))
        if keep_rows:
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            least, largest, tests = least[of], largest[of], tests[of]
            kept = table
        else:
            some = np.flatnonzero(tests)
            kept = table.take(pa.array(rows[first[some]]))
            least, largest, tests, rows = least[some], largest[some], tests[some], np.arange(len(some))
        results = [R.column(v, tests == 0, rows, len(kept), kind) for v, kind in ((least, pa.float64()), (largest, pa.float64()), (tests, pa.int64()))]
        return pa.Table.from_arrays([*(kept.column(c) for c in columns), *results], names=out.names)

    rows = df if keep_rows else df.where(F.col(metric).isNotNull())
    return _by_career(rows, entity, order, metric, [F.col(group).alias("__k")], compute, out)


# --- contributor verdicts ---------------------------------------------------------------------


def weighted_three_seasons(now: str, games: str, last: str, last_games: str, before: str, before_games: str) -> Column:
    """Mean of three seasons weighted by games; needs activity in both earlier ones."""
    g = F.col(games)
    total = F.when(g > 0, F.col(now) * g).otherwise(0.0) + F.col(last) * F.col(last_games) + F.col(before) * F.col(before_games)
    active = (F.col(last_games) > 0) & (F.col(before_games) > 0)
    return F.when(active, F.try_divide(total, g + F.col(last_games) + F.col(before_games)))


def contributor_verdict(metric: str, p_play: str, p_move: str, share: str | None, low: float | None, high: float | None, alpha: float, min_share: float | None) -> Column:
    """Is the entity a key contributor?  The first rule that applies decides."""
    m = F.col(metric)
    low_c, high_c = F.lit(low).cast("double"), F.lit(high).cast("double")
    out = F.when(m.isNull(), False).when(m < low_c, False).when(F.col(p_play) > alpha, False).when(F.col(p_move) < alpha, False)
    if share is not None:
        out = out.when(F.col(share) < min_share, False)
    return out.when(F.col(p_play).isNull() & (m < high_c), False).otherwise(True)


FULL_PRACTICE = "Full Participation in Practice"  # fixed value


def availability(reports: DataFrame, inactive: DataFrame, keys: Keys, first: str, full: str = FULL_PRACTICE) -> DataFrame:
    """First report per key with its flags, joined with roster rows that are not active.

    ``reports``: keys, ``first`` (order), injury, practice, status.  ``inactive``: keys.
    """
    cols = ["injury", "practice", "status"]
    opening = reports.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(first)).alias("_r")).select(*keys, "_r.*")
    flagged = opening.select(
        *keys, C.mentions("injury", C.ILLNESS_WORDS).alias("illness"), C.mentions("injury", C.NOT_INJURY_WORDS).alias("out_not_injury_related"),
        (F.col("practice") != full).alias("less_practice"), F.col("status").alias("_status"),
    )
    joined = flagged.join(inactive.select(*keys).distinct().withColumn("_inactive", F.lit("Out")), list(keys), "full_outer")
    out = (F.col("_status") == "Out") | (F.col("_inactive") == "Out")
    return joined.select(*keys, "illness", "out_not_injury_related", "less_practice", F.coalesce(out, F.lit(False)).alias("out"))


def contributors_out(flags: DataFrame, injuries: DataFrame, keys: Keys, group: Keys, cols: Keys) -> DataFrame:
    """Per group: is any key contributor of each kind out?"""
    joined = flags.join(injuries.select(*keys, "out"), list(keys), "left").withColumn("out", F.coalesce("out", F.lit(False)))
    return joined.groupBy(*group).agg(*[F.bool_or(F.col("out") & F.col(c)).alias(f"has_{c}_out") for c in cols])


# --- shares and workloads ---------------------------------------------------------------------


def talent_baseline(share: str, last: str, before: str, newcomer: str, games: str, career: str) -> Column:
    """Share an entity is worth: its own after five games, before that blended with the past."""
    g = F.col(games)
    past = F.coalesce(last, before, newcomer)
    blend = g / 6.0
    veteran = F.col(career) > g
    return (
        F.when(g > 5, F.col(share))
        .when((g > 0) & veteran, blend * F.col(share) + (1 - blend) * past)
        .when(veteran, past)
        .when(g > 0, blend * F.col(share) + (1 - blend) * F.col(newcomer))
        .otherwise(F.col(newcomer))
    )


def active_share(df: DataFrame, group: Keys, talent: str, out: str, games: str, recent: str) -> DataFrame:
    """Talent over the total of those who play, and how recent form differs from it."""
    playing = df.where(~F.coalesce(F.col(out), F.lit(False)))
    totals = playing.groupBy(*group).agg(F.sum(talent).alias("_total"))
    share = F.try_divide(talent, "_total")
    return playing.join(totals, list(group)).select(
        *df.columns, share.alias("adjusted_share"), (share - F.col(talent)).alias("delta_adjusted_share"),
        F.when(F.col(games) == 0, 0.0).otherwise(F.col(recent) - F.col(talent)).alias("recent_form_delta"),
    ).drop("_total")


def leader_workload(panel: DataFrame, leader: str, season: str, order: Keys, measure: str, last: int = 30) -> DataFrame:
    """Mean of a measure over the leader's earlier games, only for leaders of an earlier season.

    ``panel`` has one row per leader and period.
    """
    led = F.row_number().over(Window.partitionBy(leader).orderBy(*order)) - 1
    led_now = F.row_number().over(Window.partitionBy(leader, season).orderBy(*order)) - 1
    mean = F.avg(measure).over(prior([leader], order, last))
    return panel.select("*", F.when(led > led_now, mean).alias("leader_workload"))


def first_known(choices: Mapping[str, Column | str]) -> tuple[Column, Column]:
    """The first known of several estimates, and the name of the one that was taken (NULL where none is known)."""
    cols = {name: F.col(c) if isinstance(c, str) else c for name, c in choices.items()}
    taken = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in cols.items()])
    return F.coalesce(*cols.values()), taken


def volume_class(volume: Column, thresholds: tuple[float | None, float | None]) -> Column:
    """High, Medium or Low; an unknown volume counts as Low."""
    medium, high = (F.lit(t).cast("double") for t in thresholds)
    return F.when(volume > high, "High").when(volume > medium, "Medium").otherwise("Low")


def stakes_flags(scenarios: DataFrame, keys: Keys, entity: str, lines: str, clinch: str = "clinch", eliminate: str = "eliminat") -> DataFrame:
    """Is the entity named in the clinch or elimination scenarios of its own text?"""
    each = scenarios.select(*keys, entity, F.explode(lines).alias("line"))
    named = F.col("line").contains(F.col(entity))
    return each.groupBy(*keys, entity).agg(
        F.bool_or(named & F.lower("line").contains(clinch)).alias("could_clinch"),
        F.bool_or(named & F.lower("line").contains(eliminate)).alias("could_be_eliminated"),
        F.count("*").alias("scenarios"),
    )


# --- targets and selection --------------------------------------------------------------------


def threshold_targets(df: DataFrame, keys: Keys, measure: str, numbers: Sequence[float], root: str) -> DataFrame:
    """One row per threshold: was it reached?"""
    rung = F.explode(F.array(*[F.struct(F.lit(float(n)).alias("number"), F.lit(f"{root}_{_code(n)}").alias("response_var")) for n in numbers]))
    return df.select(*keys, measure, rung.alias("r")).select(
        *keys, F.col("r.response_var").alias("response_var"), F.when(F.col(measure).isNotNull(), (F.col(measure) >= F.col("r.number")).cast("bigint")).alias("label")
    )


def _code(n: float) -> str:
    return ("minus" if n < 0 else "") + f"{abs(n):g}"


def phase_dummies(week: str) -> dict[str, Column]:
    w = F.col(week)
    return {
        "early_season": (w < 4).cast("bigint"), "mid_season": ((w >= 4) & (w < 16)).cast("bigint"),
        "late_season": ((w >= 16) & (w < 19)).cast("bigint"), "playoffs": (w >= 19).cast("bigint"),
    }


def missing_masks(groups: Mapping[str, Keys]) -> dict[str, Column]:
    """True where every column of a group is missing."""
    out = {}
    for name, cols in groups.items():
        mask = F.lit(True)
        for c in cols:
            mask = mask & F.col(c).isNull()
        out[f"mask_{name}_missing"] = mask
    return out


def chronological_split(season: str, train_to: int) -> Column:
    s = F.col(season)
    return F.when(s <= train_to, "train").when(s == train_to + 1, "validation").otherwise("holdout")


# Parts cut from a feature's name, and words and names that tell its kind; per scope, now and for past seasons.
NAME_CUTS = {
    ("Player Stats", False): "last3_|avg_|mean_|median_|min_|max_|cv_|sd_|cumulative_|_lag[0-9]",
    ("Player Stats", True): "last_season_|two_seasons_ago_|min_|mean_|median_|max_|cv_|sd_|avg_",
    ("Team Stats", False): "team_|last3_|min_|mean_|median_|max_|avg_|cumulative_|cv_|sd_|offense_",
    ("Team Stats", True): "last_season_|two_seasons_ago_|team_|last3_|min_|mean_|median_|max_|avg_|_cumulative_|cv_|sd_|sum_|offense_",
    ("Opp Stats", False): "opp_|last3_|min_|mean_|median_|max_|avg_|cumulative_|cv_|sd_|defense_",
    ("Opp Stats", True): "last_season_|two_seasons_ago_|opp_|last3_|min_|mean_|median_|max_|avg_|cumulative_|cv_|sd_|defense_",
}
OPPORTUNITY_WORDS = {
    ("Player Stats", False): "att|attempt|carries|target|tgt|snap|offense|active|also_played",
    ("Player Stats", True): "att|attempt|carries|target|tgt|snap|offense|active|also_played",
    ("Team Stats", False): "att|attempt|carries|target|tgt|snap|offense|active|pct_plays|pct_drives|pct_trick|qb_shotgun|sum_qb|play_action|screen|times_",
    ("Team Stats", True): "att|attempt|carries|target|tgt|snap|offense|active|pct_plays|pct_drives|qb_shotgun|sum_qb|qb_sneaks|trick|play_action|screen|backfield",
    ("Opp Stats", False): "attempt|drives|carries|plays|per_play",
    ("Opp Stats", True): "attempt|drives|carries|plays|per_play|total",
}
OPPORTUNITY_NAMES = {
    ("Player Stats", False): ("offense_pct", "time_to_throw_per_attempt", "games_played", "also_played_defense"),
    ("Player Stats", True): ("offense_pct", "time_to_throw_per_attempt"),
    ("Team Stats", False): ("drives_in_redzone", "drives", "games_played", "redzone_rushing_plays", "redzone_receiving_plays", "pace", "time_of_possession", "redzone_plays"),
    ("Team Stats", True): ("drives_in_redzone", "num_plays", "drives", "games_played", "redzone_rushing_plays", "redzone_receiving_plays", "pace", "time_of_possession", "redzone_plays"),
}
RATE_WORDS = {
    ("Player Stats", False): "per|pct",
    ("Player Stats", True): "per|pct",
    ("Team Stats", False): "per_|ratio|pct|dependency|passer_rating|aggressiveness",
    ("Team Stats", True): "per_|ratio|pct|dependency",
    ("Opp Stats", False): "per_|pct|dependency",
    ("Opp Stats", True): "per_|pct|dependency",
}
TEAM_NO_RATE = "pct_plays|pct_drives|pct_trick|matchup"
PLAYER_NO_OPPORTUNITY, PLAYER_NO_RATE = "average_depth_of_target_passer", ("offense_pct", "time_to_throw_per_attempt")


def _kind(raw: Column, scope: str, past: bool) -> Column:
    """Rates are looked for first in team features, opportunities first in the others."""
    at = (scope, past)
    chance, rate = raw.rlike(OPPORTUNITY_WORDS[at]), raw.rlike(RATE_WORDS[at])
    named = raw.isin(*OPPORTUNITY_NAMES.get(at, ("",)))
    if scope == "Team Stats":
        efficient = ((raw == "differential_per_win") | rate) & ~raw.rlike(TEAM_NO_RATE)
        return F.when(efficient, "Efficiency").when(chance | named, "Opportunity").otherwise("Production")
    if scope == "Opp Stats":
        per_play = raw.contains("per_play")
        return F.when(chance & (~raw.contains("per_") | per_play), "Opportunity").when(rate & ~per_play, "Efficiency").otherwise("Production")
    chance = chance & (raw != PLAYER_NO_OPPORTUNITY) & ~rate
    return F.when(chance | named, "Opportunity").when(rate & ~raw.contains("snap") & ~raw.isin(*PLAYER_NO_RATE), "Efficiency").otherwise("Production")


def feature_taxonomy(features: DataFrame, name: str = "feature") -> DataFrame:
    """Scope, timeframe, raw name and kind of features, from their names, by the rules of their scope."""
    f = F.col(name)
    scope = F.when(f.rlike("^(last3_|last_season_|two_seasons_ago_|[a-z]+_)?opp_"), "Opp Stats").when(f.contains("team_"), "Team Stats").otherwise("Player Stats")
    recent = F.when(F.col("scope") == "Player Stats", f.rlike("lag|last3")).otherwise(f.contains("last3"))
    frame = F.when(F.col("_past"), "Historical Seasons").when(recent, "Recent Games").otherwise("Full Current Season")
    raw = kind = F.lit(None).cast("string")
    for at, cut in NAME_CUTS.items():
        mine = (F.col("scope") == at[0]) & (F.col("_past") == at[1])
        raw = F.when(mine, F.regexp_replace(f, cut, "")).otherwise(raw)
        kind = F.when(mine, _kind(F.col("raw_name"), *at)).otherwise(kind)
    placed = features.withColumn("scope", scope).withColumn("_past", f.rlike("last_season|two_seasons_ago")).withColumn("timeframe", frame)
    return placed.withColumn("raw_name", raw).withColumn("kind", kind).drop("_past")


def long_features(df: DataFrame, keep: Keys, numeric: Keys, categorical: Keys = ()) -> DataFrame:
    """One row per row and feature: (keep, feature, v, level); one expression makes all of them, however many there are."""
    values = [F.struct(F.col(f"`{c}`").cast("double").alias("v"), F.lit(None).cast("string").alias("level")) for c in numeric]
    values += [F.struct(F.lit(None).cast("double").alias("v"), F.col(f"`{c}`").cast("string").alias("level")) for c in categorical]
    names = F.array(*[F.lit(c) for c in [*numeric, *categorical]])
    opened = df.select(*keep, F.posexplode(F.array(*values)).alias("_at", "_value"))
    return opened.select(*keep, F.get(names, F.col("_at")).alias("feature"), "_value.v", "_value.level")


def information_value(df: DataFrame, label: str, features: Keys, bins: int = 6, categorical: Keys = (), entity: str | None = None) -> DataFrame:
    """Weight of evidence per bin and the information value of each feature.

    Numeric features are cut at quantiles, and every level of a ``categorical`` one is a bin, numbered by frequency (column
    ``level``). Missing values form a bin of their own, -1, and counts are smoothed by one half so that empty classes stay
    finite. With ``entity``, ``entities`` counts the different ones in each bin. Features are rows throughout: the plan
    does not grow with their number.
    """
    keep = [F.col(label).cast("bigint").alias("_y"), *([F.col(entity).alias("_entity")] if entity else [])]
    # read again by every pass over the values, so ``df`` should be a table; rows times features are never written
    long = long_features(df.select(*keep, *[f"`{c}`" for c in [*features, *categorical]]), ["_y", *(["_entity"] if entity else [])], features, categorical)
    edges = keyed_percentiles(long.select("feature", "v"), [i / bins for i in range(1, bins)]) if features else None
    placed = long.where(~F.col("feature").isin(*categorical)) if categorical else long
    if edges is not None:
        # one short row per feature
        cut = placed.join(edges, "feature", "left").withColumn("_cuts", F.array_distinct(F.coalesce("edges", F.array().cast("array<double>"))))
        above = F.size(F.filter("_cuts", lambda e: F.col("v") > e))
        placed = cut.withColumn("bin", F.when(F.col("v").isNull(), -1).otherwise(above).cast("bigint")).drop("edges", "_cuts")
    if categorical:
        text = long.where(F.col("feature").isin(*categorical))
        counts = text.where("level is not null").groupBy("feature", "level").agg(F.count("*").alias("_n"))
        order = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("_n"), "level")).cast("bigint") - 1
        named = counts.select("feature", "level", order.alias("_place"))
        text = text.join(named, ["feature", "level"], "left").withColumn("bin", F.coalesce("_place", F.lit(-1).cast("bigint"))).drop("_place")
        placed = placed.unionByName(text) if edges is not None else text
    by = ["feature", "bin", *(["level"] if categorical else [])]
    sums = [F.sum("_y").alias("ones"), F.count("*").alias("n")]
    if entity:
        counted = placed.groupBy(*by, "_entity").agg(*sums).groupBy(*by).agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"), F.count("_entity").alias("entities"))
    else:
        counted = placed.groupBy(*by).agg(*sums)
    more = [*(["level"] if categorical else []), *(["entities"] if entity else [])]
    # one row per feature and bin from here on
    totals = counted.groupBy("feature").agg(F.sum("ones").alias("all_ones"), F.sum("n").alias("all_n"), F.count("*").alias("k"),
                                            F.coalesce(F.sum(F.when(F.col("bin") == -1, F.col("n"))), F.lit(0)).alias("missing"))
    zeros = F.col("n") - F.col("ones")
    ones_share = (F.col("ones") + 0.5) / (F.col("all_ones") + 0.5 * F.col("k"))
    zero_share = (zeros + 0.5) / (F.col("all_n") - F.col("all_ones") + 0.5 * F.col("k"))
    woe = F.ln(ones_share / zero_share)
    binned = counted.join(totals, "feature").select(
        "feature", "bin", "n", (F.col("ones") / F.col("n")).alias("positive_share"), woe.alias("woe"),
        ((ones_share - zero_share) * woe).alias("bin_iv"), (F.col("missing") / F.col("all_n")).alias("share_missing"), *more,
    )
    total = F.sum("bin_iv").over(Window.partitionBy("feature"))
    return binned.withColumn("total_iv", total).withColumn("strength", iv_strength("total_iv"))


def iv_strength(iv: str) -> Column:
    v = F.col(iv)
    return F.when(v < 0.02, "None").when(v <= 0.1, "Low").when(v <= 0.3, "Medium").when(v <= 0.5, "High").otherwise("Suspicious")


def feature_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str, float]]:
    """Correlations of some pairs of features in one aggregate, a row per pair."""
    if not pairs:
        return []
    both = F.array(*[F.struct(F.col(f"`{a}`").cast("double").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs])
    found = df.select(F.posexplode(both).alias("i", "p")).groupBy("i").agg(F.corr("p.x", "p.y").alias("r")).collect()
    r = {row["i"]: row["r"] for row in found}
    return [(a, b, r.get(i) or 0.0) for i, (a, b) in enumerate(pairs)]


def iv_tournament(df: DataFrame, iv: DataFrame, taxonomy: DataFrame, top: int = 5, max_missing: float = 0.5, limit: float = 0.9, margin: float = 0.15) -> DataFrame:
    """Best features per scope, timeframe and kind, without near copies of each other.

    Works on the feature list, which is metadata: the data are read once, for the
    correlations of the winners.
    """
    spark = df.sparkSession
    one = iv.select("feature", "total_iv", "share_missing", "strength").distinct().where(F.col("share_missing") < max_missing).where("strength <> 'None'")
    w = Window.partitionBy("scope", "timeframe", "kind").orderBy(F.desc("total_iv"), "feature")
    winners = one.join(taxonomy, "feature").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    rows = winners.select("feature", "scope", "timeframe", "kind", "total_iv").orderBy("scope", "timeframe", "kind", F.desc("total_iv"), "feature").collect()
    info = {r["feature"]: r for r in rows}
    removed: set[str] = set()
    league = lambda f: (info[f]["scope"], info[f]["timeframe"])
    # features meet in their own league only, a few winners of each kind
    pairs = [(a, b) for i, a in enumerate(info) for b in list(info)[i + 1 :] if league(a) == league(b)]
    for a, b, r in feature_correlations(df, pairs):
        x, y = info[a], info[b]
        if a in removed or b in removed or r <= limit:
            continue
        if x["kind"] == y["kind"] or abs(x["total_iv"] - y["total_iv"]) > margin:
            removed.add(a if (x["total_iv"], b) < (y["total_iv"], a) else b)
        else:
            removed.add(max(a, b))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("feature", "scope", "timeframe", "kind")] + [T.StructField("total_iv", T.DoubleType())])
    return spark.createDataFrame([tuple(r) for r in rows if r["feature"] not in removed], schema)


def either_or(pairs: DataFrame, iv: DataFrame) -> DataFrame:
    """Of two redundant features the one with the larger information value; the only one present
    if the other is not there."""
    one = iv.select("feature", "total_iv").distinct()
    long = pairs.select("option1", "option2", F.explode(F.array("option1", "option2")).alias("feature"))
    known = long.join(one, "feature")
    return known.groupBy("option1", "option2").agg(F.max_by("feature", F.struct("total_iv", "feature")).alias("decision"))
