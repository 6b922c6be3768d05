"""Stream queries (R): the feed is the events table, cut into files by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import scratch_path
from ..streaming import feeds as R
from . import domain as D
from .registry import query


def _feed(spark, d):
    """Events as a folder of files in time order: a file per shuffle partition of the session, and none too long."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = D.table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("run_time"), "user_id", "event_type",
        (F.floor(F.col("value") * 10) + 100).alias("price"),
    )
    path = scratch_path(spark, "feed")
    rows.repartitionByRange(files, "run_time").write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return R.file_feed(spark, path, rows.schema, files_per_trigger=max(1, files // 2))


@query(
    "r1_latest_snapshot",
    "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(CAST(floor(value * 10) AS BIGINT) + 100, (ts, event_id)) AS price FROM events GROUP BY user_id, event_type",
)
def r1(spark, d):
    feed = _feed(spark, d)
    state = scratch_path(spark, "state")
    R.keep_latest(feed, state, scratch_path(spark, "checkpoint"), ["user_id", "event_type"], ["run_time", "event_id"]).awaitTermination()
    return R.newest_version(spark, state, feed.schema).select("user_id", "event_type", "event_id", "price")


def _movement_sql(width: str, late: str, starts: str) -> str:
    return (
        f"SELECT CAST(window_start AS VARCHAR) AS window_start, event_type, arg_min(price, (ts, event_id)) AS first_price, arg_max(price, (ts, event_id)) AS last_price, min(price) AS lowest_price, max(price) AS highest_price, count(*) AS snapshots "
        f"FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) + 100 AS price, {starts} AS window_start FROM events) WHERE window_start + INTERVAL {width} <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL {late} FROM events) GROUP BY 1, 2"
    )


@query("r2_line_movement", _movement_sql("1 DAY", "2 HOUR", "date_trunc('day', ts)"))
def r2(spark, d):
    out = R.line_movement(_feed(spark, d), "run_time", ["event_type"], "price", "event_id", "1 day", "2 hours")
    return R.run_to_table(out, "movement").withColumn("window_start", F.col("window_start").cast("string"))


@query("r2_line_movement_sliding", _movement_sql("2 DAY", "2 HOUR", "unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])"))
def r2_sliding(spark, d):
    out = R.line_movement(_feed(spark, d), "run_time", ["event_type"], "price", "event_id", "2 days", "2 hours", slide="1 day")
    return R.run_to_table(out, "movement").withColumn("window_start", F.col("window_start").cast("string"))


@query("r3_without_repeats", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def r3(spark, d):
    feed = _feed(spark, d)
    doubled = feed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = R.without_repeats(doubled, "run_time", ["event_id", "user_id", "event_type"], "2 days")
    return R.run_to_table(out, "distinct").select("event_id", "user_id", "event_type")
