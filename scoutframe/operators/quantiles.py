"""Exact quantiles of whole columns without sorting them in one task.

``percentile`` keeps every distinct value of a column in one buffer.  For groups of
bounded size that is fine; for a whole table it is not.  Here each pass counts
rows per bin of the interval that is known to hold the wanted rank, and the
next pass looks inside the one bin that was hit.  Two to four passes reach a
single value; every pass returns at most ``bins`` small rows per wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = 1024) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column over its finite values: ``{column: [value per prob]}``."""
    df = df.select(*[_finite(F.col(c).cast("double")).alias(c) for c in cols])
    stats = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols],
    ).first()
    wanted: dict[tuple[str, int], float | None] = {}
    for c in cols:
        n = stats[f"n_{c}"]
        for p in probs if n else []:
            position = (n - 1) * p
            wanted[(c, math.floor(position))] = None
            wanted[(c, math.ceil(position))] = None
    # one bracket per wanted rank: (low, high, rows below low)
    brackets = {key: (stats[f"lo_{key[0]}"], stats[f"hi_{key[0]}"], 0) for key in wanted}
    while brackets:
        for key in [k for k, b in brackets.items() if b[0] == b[1]]:
            wanted[key] = brackets.pop(key)[0]
        if brackets:
            _narrow(df, brackets, bins)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = stats[f"n_{c}"]
        out[c] = []
        for p in probs:
            if not n:
                out[c].append(None)
                continue
            position = (n - 1) * p
            low, high = wanted[(c, math.floor(position))], wanted[(c, math.ceil(position))]
            out[c].append(low + (high - low) * (position - math.floor(position)))
    return out


def _finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def _narrow(df: DataFrame, brackets: dict[tuple[str, int], tuple[float, float, int]], bins: int) -> None:
    intervals = sorted({(c, b[0], b[1]) for (c, _), b in brackets.items()})
    tagged = []
    for i, (c, low, high) in enumerate(intervals):
        v = F.col(c).cast("double")
        # dividing each end first keeps the width finite for any pair of doubles
        width = high / bins - low / bins
        if width > 0:
            spot = F.floor(v / F.lit(width) - F.lit(low / width)).cast("bigint")
            spot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), spot))
        else:  # neighbours too close to divide: split off the lowest value
            spot = F.when(v == low, 0).otherwise(1).cast("bigint")
        tagged.append(
            F.when(v.between(low, high), F.struct(F.lit(i).alias("i"), spot.alias("bin"), v.alias("v")))
        )
    counted = (
        df.select(F.explode(F.array(*tagged)).alias("t"))
        .where("t IS NOT NULL")
        .groupBy("t.i", "t.bin")
        .agg(F.count("*").alias("n"), F.min("t.v").alias("low"), F.max("t.v").alias("high"))
        .collect()
    )
    histogram: dict[int, list] = {}
    for row in counted:
        histogram.setdefault(row["i"], []).append(row)
    for (c, rank), (low, high, below) in list(brackets.items()):
        for row in sorted(histogram[intervals.index((c, low, high))], key=lambda r: r["bin"]):
            if rank < below + row["n"]:
                brackets[(c, rank)] = (row["low"], row["high"], below)
                break
            below += row["n"]


def keyed_percentiles(long: DataFrame, probs: Sequence[float], key: str = "feature", value: str = "v", bins: int = 1024) -> DataFrame:
    """(key, edges): interpolated quantiles of each key's finite values, in order of ``probs``; keys without values are left out.

    Brackets of wanted ranks are rows, not expressions, so the plan is the same for one key and for thousands. Every pass
    reads ``long`` once: a value lies in one open bracket of its key at most, and is counted there.
    """
    v = F.col(value)
    finite = long.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(F.col(key).alias("key"), v.alias("v"))
    stats = finite.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    position = (F.col("n") - 1) * F.col("prob")
    asked = staged(stats.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("place", "prob")).select(
        "key", "place", "low", "high", position.alias("position"), F.explode(F.array(F.floor(position), F.ceil(position))).alias("rank")
    ), "ranks")
    found = asked.select("key", "rank", "low", "high", F.lit(0).cast("long").alias("below")).distinct()
    while True:
        found = staged(found, "brackets")
        open_ = found.where("low < high")
        if open_.isEmpty():
            break
        spans = open_.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))  # two per prob at most
        hit = finite.join(spans, "key").select("key", "v", F.get(F.filter("spans", lambda s: F.col("v").between(s["low"], s["high"])), F.lit(0)).alias("s"))
        # dividing each end first keeps the width finite for any pair of doubles; neighbours too close to divide are split in two
        width = F.expr(f"s.high / {bins} - s.low / {bins}")
        spot = F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("v") / width - F.col("s.low") / width)))).otherwise((F.col("v") > F.col("s.low")).cast("long"))
        counted = hit.where("s is not null").groupBy("key", F.col("s.low").alias("low"), F.col("s.high").alias("high"), spot.alias("spot")).agg(
            F.count("*").alias("n"), F.min("v").alias("from"), F.max("v").alias("to")
        )
        before = F.sum("n").over(Window.partitionBy("key", "low", "high").orderBy("spot")) - F.col("n")  # a bracket has ``bins`` rows at most
        inside = (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("n"))
        closer = open_.join(counted.withColumn("before", before), ["key", "low", "high"]).where(inside)
        closer = closer.select("key", "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("before")).alias("below"))
        found = found.where("low = high").unionByName(closer)
    ends = asked.select("key", "place", "position", "rank").join(found.select("key", "rank", F.col("low").alias("at")), ["key", "rank"])
    part = F.col("position") - F.floor("position")
    edges = ends.groupBy("key", "place").agg((F.min_by("at", "rank") + (F.max_by("at", "rank") - F.min_by("at", "rank")) * F.max(part)).alias("edge"))
    return edges.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "edge"))).alias("e")).select(F.col("key").alias(key), F.col("e.edge").alias("edges"))
