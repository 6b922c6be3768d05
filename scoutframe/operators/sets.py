"""Unions, slices, distinct rows, differences and report numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_wide(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def replace_slice(df: DataFrame, condition: Column, rows: DataFrame) -> DataFrame:
    """Drop the rows of a slice and put new ones in; unknown rows are not in the slice."""
    return df.where(~F.coalesce(condition, F.lit(False))).unionByName(rows)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keys_without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti").distinct()


def newest_period(df: DataFrame, period: Column) -> DataFrame:
    """Rows of the newest period; the maximum is one row and is broadcast."""
    stamped = df.withColumn("_period", period)
    newest = stamped.agg(F.max("_period").alias("_period"))
    return stamped.join(F.broadcast(newest), "_period", "left_semi").drop("_period")


def numbered_report(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Line numbers over the whole report from a count per group and a rank inside it.

    ``group`` must be the leading part of ``order``; no task sees the whole report.
    """
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        df.withColumn("_line", inside)
        .join(offsets, list(group))
        .withColumn(name, (F.col("_line") + F.col("_before")).cast("bigint"))
        .drop("_line", "_before")
    )
