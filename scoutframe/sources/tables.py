"""Reading, paging, upserting and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read_seasons(spark: SparkSession, path: str, first: int, last: int, stamp: str | None = None) -> DataFrame:
    """Rows of some seasons.

    A table partitioned by ``season`` is pruned by folder.  Otherwise the limits are
    put on the time column itself, so that they reach the parquet scan.
    """
    df = spark.read.parquet(path)
    if stamp is None:
        return df.where(F.col("season").between(first, last))
    kind = df.schema[stamp].dataType.simpleString()
    low, high = (F.lit(f"{y}-01-01").cast(kind) for y in (first, last + 1))
    return df.where((F.col(stamp) >= low) & (F.col(stamp) < high))


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None,
    equals: Mapping[str, object] | None = None, order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Columns and equality predicates of a table; both reach the scan."""
    df = spark.read.parquet(path)
    for c, value in (equals or {}).items():
        df = df.where(F.col(c).isin(*value) if isinstance(value, (list, tuple)) else F.col(c) == value)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*order_by) if order_by else df


def keyset_page(df: DataFrame, keys: Sequence[str], cursor: Sequence[object] | None, size: int) -> DataFrame:
    """The next ``size`` rows after a cursor in key order (the page is the feature)."""
    if cursor is not None:
        after: Column | None = None
        for i in reversed(range(len(keys))):
            greater, equal = F.col(keys[i]) > cursor[i], F.col(keys[i]) == cursor[i]
            after = greater if after is None else greater | (equal & after)
        # the leading key alone is a plain comparison that parquet can skip on
        df = df.where(F.col(keys[0]) >= cursor[0]).where(after)
    return df.orderBy(*keys).limit(size)


def next_cursor(page: DataFrame, keys: Sequence[str], cursor: Sequence[object] | None) -> tuple | None:
    """Largest key of the page; an error when the cursor does not move, None at the end."""
    last = page.agg(F.max(F.struct(*keys)).alias("k")).first()["k"]
    if last is None:
        return None
    if cursor is not None and tuple(last) == tuple(cursor):
        raise RuntimeError("the page did not advance beyond its cursor")
    return tuple(last)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], newest: Sequence[str] | None = None) -> DataFrame:
    """Target with the newest update per key put in place of the row it conflicts with."""
    if not keys:
        raise ValueError("an upsert needs at least one key column")
    missing = [k for k in keys if k not in updates.columns or k not in target.columns]
    if missing:
        raise ValueError(f"key columns not in both tables: {', '.join(missing)}")
    order = list(newest) if newest else [c for c in updates.columns if c not in keys]
    rest = [c for c in updates.columns if c not in keys]
    latest = (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )
    untouched = target.join(latest.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(latest, allowMissingColumns=True).select(*target.columns)


def write_by_target(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per target and split; a frequent target is spread over several tasks."""
    df.hint("rebalance", "response_var", "split").write.mode(mode).partitionBy("response_var", "split").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a stage boundary to the shared folder and go on from what was written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ODDS_DOCUMENT = (
    "events ARRAY<STRUCT<id: STRING, name: STRING, startEventDate: STRING>>, "
    "markets ARRAY<STRUCT<id: STRING, eventId: STRING, name: STRING>>, "
    "selections ARRAY<STRUCT<id: STRING, marketId: STRING, label: STRING, points: DOUBLE, displayOdds: STRUCT<american: STRING>>>"
)


def _by_id(rows: Column) -> Column:
    """Entries of a level that have an id, sorted by it."""
    return F.array_sort(F.filter(F.transform(rows, lambda r: F.struct(r["id"].alias("id"), r.alias("row"))), lambda r: r["id"].isNotNull()))


def _with_id(ordered: Column, wanted: Column) -> Column:
    """All entries of a sorted level under one id, found by halving: first place not before it, first place after it."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + F.lit(1))).cast("int"))

    def place(before) -> Column:
        def halve(at: Column, _: Column) -> Column:
            middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
            less = before(F.get(ordered, middle)["id"])
            open_ = at["low"] < at["high"]
            return F.struct(
                F.when(open_ & less, middle + 1).otherwise(at["low"]).alias("low"),
                F.when(open_ & ~less, middle).otherwise(at["high"]).alias("high"),
            )

        start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
        return F.aggregate(steps, start, halve, lambda at: at["low"])

    first = place(lambda other: other < wanted)
    found = F.slice(ordered, first + 1, place(lambda other: other <= wanted) - first)
    nothing = F.slice(ordered, 1, 0)
    return F.transform(F.when(wanted.isNull() | (F.size(ordered) == 0), nothing).otherwise(found), lambda r: r["row"])


def odds_lines(documents: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Nested odds documents to one row per line: event with market with selection.

    The three levels belong to one document, so they are matched inside its row and
    nothing is shuffled.  Events and markets are sorted by id once per document and each
    selection finds its own by halving, before anything is exploded: the work is
    (m + s) log m, and no row carries its document.  An inner join: what has no partner
    or no id gives no line, repeated ids give a line each.
    """
    doc = documents.select(*keys, F.from_json(text, ODDS_DOCUMENT).alias("d"))
    sorted_levels = doc.select(*keys, _by_id(F.col("d.events")).alias("events"), _by_id(F.col("d.markets")).alias("markets"), "d.selections")
    found = sorted_levels.select(
        *keys,
        F.explode(F.transform("selections", lambda s: F.struct(s.alias("s"), F.transform(
            _with_id(F.col("markets"), s["marketId"]),
            lambda m: F.struct(m.alias("m"), _with_id(F.col("events"), m["eventId"]).alias("events")),
        ).alias("markets")))).alias("line"),
    )
    rows = found.select(*keys, "line.s", F.explode("line.markets").alias("market"))
    rows = rows.select(*keys, "s", "market.m", F.explode("market.events").alias("e"))
    return rows.select(
        *keys,
        F.col("e.id").alias("eventId"), F.col("e.name").alias("EventName"), F.col("e.startEventDate").alias("startEventDate"),
        F.col("m.id").alias("marketId"), F.col("m.name").alias("name"),
        F.col("s.id").alias("selectionId"), F.col("s.label").alias("label"), F.col("s.points").alias("points"),
        F.regexp_replace("s.displayOdds.american", "−", "-").alias("americanOdds"),
    )


def page_rows(pages: DataFrame, html: str, keys: Sequence[str], pattern: str, fields: Sequence[str]) -> DataFrame:
    """Repeated markup of a page to rows, in page order; one capture group per field."""
    found = [F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(i + 1)).alias(f) for i, f in enumerate(fields)]
    zipped = pages.select(*keys, F.arrays_zip(*found).alias("rows"))
    return zipped.select(*keys, F.posexplode("rows").alias("position", "r")).select(
        *keys, "position", *[F.col(f"r.{f}").alias(f) for f in fields]
    )
