"""Joins on entity-period tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, prefix: str) -> DataFrame:
    """Left join of a dimension in a role: its columns get the prefix of the role.

    No hint: Spark broadcasts the dimension by its size, or shuffles when it is large.
    """
    role = dim.select(F.col(dim_key).alias(key), *[F.col(c).alias(prefix + c) for c in dim.columns if c != dim_key])
    return df.join(role, key, "left")


def lag_periods(df: DataFrame, by: Keys, season: str, cols: Keys, steps: Mapping[int, str]) -> DataFrame:
    """Values of earlier seasons joined by the season number, so a gap gives NULL.

    ``df`` has one row per key and season.
    """
    out = df
    for back, prefix in steps.items():
        earlier = df.select(*by, (F.col(season) + back).alias(season), *[F.col(c).alias(prefix + c) for c in cols])
        out = out.join(earlier, [*by, season], "left")
    return out


def within_interval(events: DataFrame, intervals: DataFrame, on: Keys, stamp: str, start: str, end: str, period: str) -> DataFrame:
    """The period an event's time falls in; 0 when it falls in none.

    Intervals are listed under every calendar day they touch, so an event looks up the
    one or two intervals of its own day by equality.  They travel as an array: one
    output row per event, and no comparison with intervals of other days.  Where
    intervals overlap the latest one wins.
    """
    day = F.explode(F.sequence(F.to_date(start), F.to_date(end)))
    spans = intervals.where(F.col(start) <= F.col(end)).select(
        *on, day.alias("_day"), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(period).alias("p")).alias("x")
    )
    daily = spans.groupBy(*on, "_day").agg(F.sort_array(F.collect_list("x"), asc=False).alias("_spans"))
    joined = events.withColumn("_day", F.to_date(stamp)).join(daily, [*on, "_day"], "left")
    hit = F.filter("_spans", lambda x: (x["s"] <= F.col(stamp)) & (F.col(stamp) <= x["e"]))
    return joined.withColumn(period, F.coalesce(F.get(hit, F.lit(0))["p"], F.lit(0).cast("bigint"))).drop("_spans", "_day")


def context_join(df: DataFrame, context: DataFrame, key: str, fallback: str, context_key: str, on: Keys, cols: Mapping[str, str]) -> DataFrame:
    """Statistics of a linked entity, with a fallback link where the first is unknown."""
    linked = df.withColumn("_link", F.coalesce(F.col(key), F.col(fallback)))
    stats = context.select(F.col(context_key).alias("_link"), *on, *[F.col(c).alias(n) for c, n in cols.items()])
    return linked.join(stats, ["_link", *on], "left").withColumnRenamed("_link", f"{key}_used")


def resolve_names(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column, aliases: DataFrame | None = None) -> DataFrame:
    """Match two sources on a cleaned name, after an alias table has been applied."""
    l = left.withColumn("_key", left_key)
    if aliases is not None:
        l = l.join(aliases.select(F.col("alias").alias("_key"), F.col("name").alias("_name")), "_key", "left")
        l = l.withColumn("_key", F.coalesce("_name", "_key")).drop("_name")
    return l.join(right.withColumn("_key", right_key), "_key", "left").withColumnRenamed("_key", "name_key")


def plain_words(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-zà-ÿ]+", " ")), " ")


def dictionary_matches(texts: DataFrame, keys: Keys, text: str, names: DataFrame, name: str) -> DataFrame:
    """Known names that occur in a text as whole words.

    Each word of a text is looked up by equality as the first word of a name, and the
    words after it are compared with the rest of that name: no comparison of every text
    with every name, and no phrase is built for words that start no name.
    """
    known = names.select(plain_words(name).alias("d")).where("d[0] <> ''").distinct()
    longest = known.agg(F.max(F.size("d"))).first()[0] or 1
    rest = [F.get("d", F.lit(i)).alias(f"d{i}") for i in range(longest)]
    dictionary = known.select(F.array_join("d", " ").alias("name_key"), *rest)
    words = texts.select(*keys, plain_words(text).alias("w"))
    shifted = [F.col("w")] + [F.slice("w", i + 1, F.size("w")) for i in range(1, longest)]
    run = F.arrays_zip(*[x.alias(f"w{i}") for i, x in enumerate(shifted)])
    spots = words.select(*keys, F.explode(run).alias("r")).select(*keys, *[F.col(f"r.w{i}").alias(f"w{i}") for i in range(longest)])
    match = F.col("w0") == F.col("d0")
    for i in range(1, longest):
        match = match & (F.col(f"d{i}").isNull() | (F.col(f"w{i}") == F.col(f"d{i}")))
    return spots.join(dictionary, match).select(*keys, "name_key").distinct()


def as_of(df: DataFrame, versions: DataFrame, on: Keys, period: str, version_period: str, created: Sequence[str], cols: Keys, back: int = 1) -> DataFrame:
    """The newest version made for a period at least ``back`` before the row's period.

    Versions are first cut to one per key and period; those few travel as an array.
    """
    newest = versions.groupBy(*on, version_period).agg(
        F.max_by(F.struct(*cols), F.struct(*created)).alias("_v")
    )
    arrays = newest.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct(F.col(version_period).alias("t"), F.col("_v"))), asc=False).alias("_all")
    )
    joined = df.join(arrays, list(on), "left")
    usable = F.filter("_all", lambda v: v["t"] <= F.col(period) - back)
    pick = F.get(usable, F.lit(0))
    return joined.select(*df.columns, pick["t"].alias("version_period"), *[pick["_v"][c].alias(c) for c in cols])


def duplicate_keys(df: DataFrame, keys: Keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).between(low, high))


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with one example when a contract is broken."""
    example = violations.take(1)
    if example:
        raise ValueError(f"{message}: {example[0].asDict()}")


def pair_summary(df: DataFrame, group: Keys, value: str) -> DataFrame:
    """Count, sum and mean product over all ordered pairs of different rows of a group.

    Follows from the group's sums, so a group of n rows costs one row and not n².
    """
    v = F.col(value).cast("double")
    sums = df.where(v.isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )
    n = F.col("n")
    pairs = n * (n - 1)
    return sums.where("n > 1").select(
        *group, pairs.alias("n_pairs"), (F.col("s") * F.col("s") - F.col("ss")).alias("sum_products"),
        F.try_divide(F.col("s") * F.col("s") - F.col("ss"), pairs).alias("mean_product"),
    )


def opposing_summary(df: DataFrame, period: Keys, team: str, opponent: str, value: str) -> DataFrame:
    """The same sums over all pairs of a row and a row of the opposing group."""
    v = F.col(value).cast("double")
    sums = df.where(v.isNotNull()).groupBy(*period, team, opponent).agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    other = sums.select(*period, F.col(team).alias(opponent), F.col("n").alias("n2"), F.col("s").alias("s2"))
    return sums.join(other, [*period, opponent]).select(
        *period, team, opponent, (F.col("n") * F.col("n2")).alias("n_pairs"), (F.col("s") * F.col("s2")).alias("sum_products"),
    )
