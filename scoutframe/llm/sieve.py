"""A filter of bounded size in front of a join: most rows without a partner end where they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25  # 4 MB when every bit's group is present; the bound does not depend on the data
_PER_MAP = 32_768  # bits in one of Spark's bitmaps


def _slot(columns: list[str]):
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def _marked(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """rows with ``__sieve_hit``: true for all rows with a partner, and for a few without."""
    slot = wanted.select(_slot(columns).alias("slot"))
    maps = slot.groupBy(F.expr(f"slot div {_PER_MAP}").alias("__sieve_map")).agg(F.bitmap_construct_agg(F.col("slot") % _PER_MAP).alias("__sieve_bits"))
    marked = rows.withColumn("__sieve_slot", _slot(columns)).withColumn("__sieve_map", F.expr(f"__sieve_slot div {_PER_MAP}"))
    joined = marked.join(F.broadcast(maps), "__sieve_map", "left")
    byte = F.expr(f"cast(conv(hex(substring(__sieve_bits, cast(__sieve_slot % {_PER_MAP} div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("shiftleft(1, cast(__sieve_slot % 8 as int))")
    hit = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    return joined.withColumn("__sieve_hit", hit).drop("__sieve_map", "__sieve_slot", "__sieve_bits")


def sieve(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns' hash is among those of ``wanted``; the join that decides must follow.

    At most BITS / 32,768 bitmaps of 4 KB are broadcast. With more keys than bits nothing is filtered, and the result after
    the join is the same.
    """
    return _marked(rows, wanted, columns).where("__sieve_hit").drop("__sieve_hit")


def sieve_out(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The other rows: none of them has a partner."""
    return _marked(rows, wanted, columns).where("not __sieve_hit").drop("__sieve_hit")
