"""Mixing sources to target weights by capped water-filling.

Sources share a total in proportion to their weights. A source's target is clamped at ``max_epochs`` times its size;
what that frees is shared again by weight among the others. The end of that process is a water level: target =
min(max_epochs * size, level * weight), and the level follows from running sums over the sources in the order in which
they fill up. A target is met by whole repetitions of all documents of the source, and by one fractional repetition
that takes documents in a seeded order until the words are used up (the last one in part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, narrow

WORD = r"[^\\x20\\x09-\\x0D]+"
SLOT_DIGITS = 4  # hex digits of the seeded order that name a slot: 65,536 slots a source


def word_count(column: str):
    return F.expr(f"coalesce(regexp_count({column}, '{WORD}'), 0)").cast("long")


def _turn(key, number, seed: str):
    """Place in the seeded order: by id, and without one by the row's number, so that such rows lie all over it."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.concat(F.lit(":"), number.cast("string")))))


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 2) -> DataFrame:
    """(absent, source, size) per source -> with weight and target; sources by code point, NULL (absent) last.

    One row per source goes through one window; the number of sources does not grow with their documents.
    """
    place = F.row_number().over(Window.orderBy("absent", "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_epochs)))
    order = Window.orderBy(F.col("most") / F.col("weight"), "absent", "source")
    everything = Window.partitionBy()
    filled = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = F.when((budget - filled) / open_weight <= F.col("most") / F.col("weight"), (budget - filled) / open_weight)
    leveled = ranked.withColumn("own_level", level)
    # the first source in filling order that is not full sets the level; full ones have no level of their own
    first = F.first("own_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(first * F.col("weight"), F.col("most")))
    return leveled.select("absent", "source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 2,
    seed: str = "mix-1",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, whole (repetitions), part (words of one more), taken.

    The seeded order is md5(seed, id), then the number of the row. A slot is a stretch of that order; sums per slot place each slot against the
    source's quota, so that no window holds more than one slot of a source, however large the source is.

    Defined results: NULL or empty text has size 0 and is taken 0 times over; NULL sources are one source, the last;
    a row with a NULL id is ordered by its number in the table; repeated rows count and are taken row by row; a source of
    size 0 gets target 0; an empty table gives no rows; other columns are ignored.
    """
    own = narrow(docs, key=id_column, text=text_column, source=source_column).withColumn("number", F.monotonically_increasing_id())
    mixed = _mix(own, share, weights, max_epochs, seed)
    return mixed.select(F.col("key").alias(id_column), "source", "size", "source_size", "target", "whole", "part", "taken")


def _mix(own: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 2, seed: str = "mix-1") -> DataFrame:
    """The mixture of rows (key, text, source, number)."""
    rows = own.select(
        "key",
        "number",
        F.col("source").isNull().alias("absent"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count("text").alias("size"),
        _turn(F.col("key"), F.col("number"), seed).alias("turn"),
    )
    rows = durable(rows.withColumn("slot", F.substring("turn", 1, SLOT_DIGITS)))
    slots = rows.groupBy("absent", "source", "slot").agg(F.sum("size").alias("slot_size"))
    sizes = slots.groupBy("absent", "source").agg(F.sum("slot_size").alias("source_size"))
    targets = source_targets(sizes, share, weights, max_epochs)
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("whole", passes).withColumn("quota", words - F.col("whole") * F.col("source_size"))
    order = Window.partitionBy("absent", "source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(order), F.lit(0)))
    placed = rows.join(slots.join(targets, ["absent", "source"]), ["absent", "source", "slot"])
    inside = Window.partitionBy("absent", "source", "slot").orderBy("turn", "key", "number").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("quota") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    out = placed.withColumn("part", part.cast("long"))
    return out.select(
        "key", "number", "turn",
        F.when(~F.col("absent"), F.col("source")).alias("source"),
        "size", "source_size", "target", "whole", "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
    )


BROADCAST_SOURCES = 20_000  # beyond so many sources their plan is joined by a shuffle


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of docs.

    A source's plan is one row: the whole repetitions, and the place in the seeded order up to which the fractional
    repetition reaches. The row at that place gives its first words, cut before white space. Rows are numbered and
    written first, so that rows without an id and rows that share one have places of their own.
    """
    seed = options.get("seed", "mix-1")
    numbered = durable(docs.withColumn("__mix_number", F.monotonically_increasing_id()))
    own = narrow(numbered, key=id_column, text=text_column, source=source_column, number="__mix_number")
    reached = F.max(F.when(F.col("part") > 0, F.struct("turn", "key", "number", "part", "size")))
    plan = _mix(own, **options)
    plan = plan.groupBy(F.col("source").alias("__mix_source")).agg(F.max("whole").alias("__mix_whole"), reached.alias("__mix_reached"))
    plan = durable(plan)
    few = plan.count() <= BROADCAST_SOURCES
    joined = numbered.join(F.broadcast(plan) if few else plan, F.col(f"`{source_column}`").eqNullSafe(F.col("__mix_source")))
    # by turn, then id, NULL ids first, then number
    key, number = F.col(f"`{id_column}`"), F.col("__mix_number")
    own = F.struct(_turn(key, number, seed).alias("turn"), key.alias("key"), number.alias("number"))
    edge = F.struct(*[F.col(f"__mix_reached.{c}").alias(c) for c in ("turn", "key", "number")])
    inside = F.when(F.col("__mix_reached").isNull() | (own > edge), 0).when(own.eqNullSafe(edge), 1).otherwise(2)
    joined = joined.withColumn("__mix_inside", inside)
    repeats = (F.col("__mix_whole") + (F.col("__mix_inside") > 0).cast("long")).cast("int")
    copies = joined.where(repeats > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), repeats)))
    pieces = F.split(F.col(f"`{text_column}`"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("__mix_reached.part").cast("int")), "")
    partial = (F.col("__mix_inside") == 1) & (F.col("__mix_copy") > F.col("__mix_whole")) & (F.col("__mix_reached.part") < F.col("__mix_reached.size"))
    text = F.when(partial, cut).otherwise(F.col(f"`{text_column}`"))
    return copies.withColumn(text_column, text).select(*[f"`{c}`" for c in docs.columns])


ORACLE = """
WITH own AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('mix-1:' || doc_id) AS turn
  FROM documents),
sizes AS (SELECT absent, source, sum(size)::DOUBLE AS source_size FROM own GROUP BY ALL),
ranked AS (
  SELECT *, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY absent, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sizes),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY most / weight, absent, source)),
targets AS (
  SELECT absent, source, source_size, least(most, weight * (SELECT min_by(level, most / weight) FROM levels WHERE level <= most / weight)) AS target FROM levels),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, round(target) - whole * source_size
         - coalesce(sum(size) OVER (PARTITION BY absent, source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
  FROM own JOIN quotas USING (absent, source))
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 4) AS target,
       (whole * size + greatest(0, least(size, remaining)))::BIGINT AS taken
FROM placed
"""
