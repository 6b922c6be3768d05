"""Roll-ups, seasonal summaries, reliability tables and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..sources.tables import staged

Keys = Sequence[str]


def seasonal_summary(df: DataFrame, by: Keys, cols: Keys, period: str) -> DataFrame:
    """Every measure by every summary function, with the number of active periods."""
    out = [F.count_distinct(period).alias("weeks_active")]
    for c in cols:
        out += [
            F.sum(c).alias(f"sum_{c}"),
            F.avg(c).alias(f"avg_{c}"),
            F.percentile(c, F.lit(0.5)).alias(f"median_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.stddev_samp(c).alias(f"sd_{c}"),
            F.try_divide(F.stddev_samp(c), F.avg(c)).alias(f"cv_{c}"),
        ]
    return df.groupBy(*by).agg(*out)


def with_group_totals(df: DataFrame, keys: Keys, cols: Keys, prefix: str = "team_") -> DataFrame:
    """Group totals on every row; NULL where all inputs of the group are NULL."""
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(prefix + c) for c in cols])
    return df.join(totals, list(keys))


def minutes_from_clock(c: str) -> Column:
    parts = F.split(c, ":")
    return parts[0].cast("double") + parts[1].cast("double") / 60.0


def ordered_text(order: Sequence[str], text: str, sep: str) -> Column:
    """Aggregate: texts of a bounded group joined in order."""
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def conference_text(df: DataFrame, keys: Keys, title: str, parts: Keys, order: Keys) -> DataFrame:
    """One text per key of the posts whose title names a press conference, in order.

    A post is its title and ``parts`` joined by a blank, unknown ones left out; posts are set apart by an empty line. A key's
    posts become one value: a team's week has a few.  Use ``text_segments`` where a key may hold any number.
    """
    posts = df.where(C.is_press_conference(title)).withColumn("_post", F.concat_ws(" ", title, *parts))
    coach = F.bool_or(C.mentions(title, "coach")).alias("has_coach")
    return posts.groupBy(*keys).agg(ordered_text(order, "_post", "\n\n").alias("conference_text"), coach, F.count("*").alias("n_posts"))


def text_segments(df: DataFrame, keys: Keys, order: str, text: str, size: int, sep: str = "\n") -> DataFrame:
    """Ordered texts of a group in segments of ``size`` positions.

    The group may be of any size: each output row holds the texts of one segment only.
    """
    return (
        df.withColumn("segment", F.floor(F.col(order) / size).cast("bigint"))
        .groupBy(*keys, "segment")
        .agg(ordered_text([order], text, sep).alias("joined_text"), F.count("*").alias("n_texts"))
    )


def settle(df: DataFrame, stake: Column) -> DataFrame:
    """Amount staked and amount paid back per bet."""
    paid = F.when(F.col("bet_hit"), C.payout(stake, "odds")).otherwise(0.0)
    return df.select("*", stake.alias("amount"), paid.alias("result_payout"))


def return_rollup(settled: DataFrame, by: Keys) -> DataFrame:
    """Payout, spent, counts, median odds and return; odds take few distinct values."""
    agg = settled.groupBy(*by).agg(
        F.sum("result_payout").alias("payout"),
        F.sum("amount").alias("spent"),
        F.count("*").alias("num_bets"),
        F.count_if("bet_hit").alias("num_won_bets"),
        F.percentile("odds", F.lit(0.5)).alias("med_odds"),
    )
    return agg.withColumn("total_return", F.try_divide(F.col("payout") - F.col("spent"), F.col("spent")))


def reliability_table(df: DataFrame, p: str, hit: str, by: Keys = ()) -> DataFrame:
    """Hit rate per probability bin and its verdict."""
    floor, ceiling = F.col("probability_floor"), F.col("probability_ceiling")
    bins = (
        C.with_probability_bin(df.select(*by, p, hit), p)
        .groupBy(*by, "probability_range", "probability_floor", "probability_ceiling")
        .agg(
            F.avg(F.col(hit).cast("double")).alias("pct_win"),
            F.count("*").alias("n"),
            F.avg(p).alias("mean_prediction"),
        )
    )
    near = (F.abs(F.col("pct_win") - ceiling) < floor * 0.1) | (F.abs(floor - F.col("pct_win")) < floor * 0.1)
    verdict = (
        F.when(F.col("n") < 10, "Insufficient Data")
        .when(F.col("pct_win").between(floor, ceiling), "Inside Target Range")
        .when(near, "Near Target Range")
        .otherwise("Bad")
    )
    return bins.withColumn("assessment", verdict)


def calibration_score(reliability: DataFrame, by: Keys = ()) -> DataFrame:
    """Distance between hit rate and prediction, weighted by the root of the bin size."""
    big = reliability.where("n >= 10").withColumn("_w", F.sqrt("n"))
    gap = F.abs(F.col("pct_win") - F.col("mean_prediction"))
    return big.groupBy(*by).agg(
        F.try_divide(F.sum(gap * F.col("_w")), F.sum("_w")).alias("calibration_score")
    )


def log_loss(p: Column | str, hit: Column | str) -> Column:
    """Row-level loss with probabilities kept away from 0 and 1."""
    q = F.least(F.greatest(F.col(p) if isinstance(p, str) else p, F.lit(1e-15)), F.lit(1.0 - 1e-15))
    return -F.when(F.col(hit) if isinstance(hit, str) else hit, F.ln(q)).otherwise(F.ln(1.0 - q))


def prevalence(df: DataFrame, by: Keys, label: str) -> DataFrame:
    """Share of positives and the log loss of always predicting that share."""
    share = df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("prevalence"), F.count("*").alias("n"))
    p = F.col("prevalence")
    loss = F.when((p > 0) & (p < 1), -(p * F.ln(p) + (1 - p) * F.ln(1 - p))).when(p.isNotNull(), 0.0)
    return share.withColumn("baseline_log_loss", loss)


def _moments(a: Column, b: Column) -> dict[str, Column]:
    """Sums over the rows in which both values are there."""
    both = a.isNotNull() & b.isNotNull()
    parts = {"n": F.lit(1.0), "sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b}
    return {k: F.sum(F.when(both, v)) for k, v in parts.items()}


def _own_moments(rows: DataFrame, position: str, x: Mapping[str, Column]) -> DataFrame:
    """Moments of two measures of one row, per position: one aggregate with a column per pair, made rows afterwards."""
    names = list(x)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = {(i, k): v.alias(f"_{i}_{k}") for i, (a, b) in enumerate(pairs) for k, v in _moments(x[a], x[b]).items()}
    wide = rows.groupBy(F.col(position).alias("position1")).agg(*sums.values())
    swapped = {"n": "n", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "sxy": "sxy"}

    def entry(i: int, a: str, b: str, turned: bool) -> Column:
        return F.struct(
            F.lit(a).alias("var1"), F.lit(b).alias("var2"),
            *[F.col(f"_{i}_{swapped[k] if turned else k}").alias(k) for k in swapped],
        )

    both_ways = [entry(i, a, b, False) for i, (a, b) in enumerate(pairs)] + [entry(i, b, a, True) for i, (a, b) in enumerate(pairs) if a != b]
    long = wide.select("position1", F.explode(F.array(*both_ways)).alias("p")).select("position1", "p.*")
    return long.where("n > 0").withColumn("position2", F.col("position1"))


def pair_correlations(
    panel: DataFrame,
    period: Keys,
    team: str,
    opponent: str,
    position: str,
    measures: Keys,
    threshold: float = 0.05,
    skip_same_team: Keys = ("QB",),
    groups: Mapping[str, str] | None = None,
    team_rows: DataFrame | None = None,
    team_measures: Keys = (),
    team_group: str = "Team",
) -> DataFrame:
    """Correlation of two measures over all pairs of team-mates, opponents, or one player.

    ``groups`` puts positions under a common name, such as WR and TE under ``WR|TE``.
    ``team_rows`` has one row per team and period with ``team_measures``: each team is
    paired with its own players, with those it faces, and with the team it faces.

    The pairs are never built.  Sums over all pairs of a group follow from sums
    over the group: sum x*y over pairs is (sum x)(sum y) less the player's own
    products.  A group of any size therefore costs one row per position and measure.
    """
    place = F.col(position)
    for one, common in (groups or {}).items():
        place = F.when(F.col(position) == one, common).otherwise(place)
    # whole-number shifts near the mean keep the moments small without rounding error
    shifted = staged(panel.select(*period, team, opponent, place.alias(position), *measures), "panel")  # read by three sums

    def centred(rows: DataFrame, names: Keys) -> dict[str, Column]:
        centre = rows.agg(*[F.round(F.avg(m)).alias(m) for m in names]).first()
        return {m: F.col(m) - F.lit(centre[m] or 0.0) for m in names}

    def sums_per_group(rows: DataFrame, x: Mapping[str, Column]) -> DataFrame:
        long = rows.select(
            *period, team, opponent, position,
            F.explode(F.array(*[F.struct(F.lit(m).alias("var"), c.alias("x")) for m, c in x.items()])).alias("m"),
        ).select(*period, team, opponent, position, "m.var", "m.x")
        return (
            long.where("x IS NOT NULL")
            .groupBy(*period, team, opponent, position, "var")
            .agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
        )

    x = centred(shifted, measures)
    cells = sums_per_group(shifted, x)
    own = _own_moments(shifted, position, x)
    alone = list(skip_same_team)
    if team_rows is not None:
        results = team_rows.select(*period, team, opponent, F.lit(team_group).alias(position), *[F.col(m).cast("double").alias(m) for m in team_measures])
        results = staged(results, "teams")
        cells = cells.unionByName(sums_per_group(results, centred(results, team_measures)))
        alone.append(team_group)  # a team is no team-mate of itself

    def side(prefix: str, keys: dict[str, str]) -> DataFrame:
        return cells.select(
            *period, *[F.col(k).alias(v) for k, v in keys.items()],
            F.col(position).alias(f"position{prefix}"), F.col("var").alias(f"var{prefix}"),
            F.col("n").alias(f"n{prefix}"), F.col("s").alias(f"s{prefix}"), F.col("ss").alias(f"ss{prefix}"),
        )

    def products(joined: DataFrame) -> DataFrame:
        e = F.expr
        return joined.groupBy("position1", "var1", "position2", "var2").agg(
            F.sum(e("CAST(n1 * n2 AS double)")).alias("n"), F.sum(e("s1 * n2")).alias("sx"),
            F.sum(e("s2 * n1")).alias("sy"), F.sum(e("ss1 * n2")).alias("sxx"),
            F.sum(e("ss2 * n1")).alias("syy"), F.sum(e("s1 * s2")).alias("sxy"),
        )

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    names = ["position1", "var1", "position2", "var2"]
    mates = products(side("1", {team: "_t"}).join(side("2", {team: "_t"}), [*period, "_t"]))
    mates = mates.join(own.select(*names, *[F.col(k).alias(f"_{k}") for k in sums]), names, "left")
    mates = mates.select(*names, *[(F.col(k) - F.coalesce(f"_{k}", F.lit(0.0))).alias(k) for k in sums])
    mates = mates.where(~(F.col("position1").isin(alone) & (F.col("position1") == F.col("position2"))))
    rivals = products(side("1", {team: "_t"}).join(side("2", {opponent: "_t"}), [*period, "_t"]))
    own = own.where("var1 <> var2").select(*names, *sums)
    everything = (
        mates.withColumn("relation", F.lit("same_team"))
        .unionByName(rivals.withColumn("relation", F.lit("opp_team")))
        .unionByName(own.withColumn("relation", F.lit("same_player")))
    )
    r = F.try_divide(
        F.expr("n * sxy - sx * sy"), F.sqrt(F.expr("n * sxx - sx * sx")) * F.sqrt(F.expr("n * syy - sy * sy"))
    )
    scored = everything.select(*names, "relation", F.col("n").cast("bigint").alias("n_pairs"), r.alias("cor"))
    return scored.where(F.abs("cor") >= threshold)


def market_comparison(bets: DataFrame, by: Keys) -> DataFrame:
    """Hit rate against the model's and the market's probability, with both errors."""
    agg = bets.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("bet_hit").cast("double")).alias("actual_pct"),
        F.avg("p").alias("model_probability"),
        F.avg(C.implied_probability("odds")).alias("line_probability"),
        F.avg(C.expected_value("p", "odds")).alias("avg_ev"),
    )
    return agg.select(
        "*",
        (F.col("model_probability") - F.col("actual_pct")).alias("model_error"),
        (F.col("line_probability") - F.col("actual_pct")).alias("line_error"),
    )
