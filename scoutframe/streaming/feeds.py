"""Streams over append-only feeds of odds and predictions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import latest_per_key
from ..sources.tables import scratch_path


def file_feed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def keep_latest(feed: DataFrame, state: str, changes: str, keys: Sequence[str], newest: Sequence[str]) -> StreamingQuery:
    """Newest row per key of a feed, held in the stream's own keyed state.

    ``state`` is the folder of the stream's checkpoint, state included.  A batch reads and
    writes the state of its own keys only, and the rows of these keys go to
    ``changes/batch=n``; a batch that is run again after a failure writes the same folder.
    What a batch writes follows the batch, not the state.  A late file may bring an older
    snapshot: the newer one stays.  For states beyond an executor's memory set Spark's
    RocksDB provider with changelog checkpointing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return (
        latest_per_key(feed, keys, newest).writeStream.outputMode("update").foreachBatch(apply)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )


def newest_version(spark: SparkSession, state: str, schema: T.StructType) -> DataFrame:
    """State after the last finished batch, read from the state store of ``keep_latest``."""
    stored = spark.read.format("statestore").load(state)
    payload = F.col("value").getField(stored.schema["value"].dataType.names[0])
    return stored.select("key.*", payload.alias("_row")).select(*stored.schema["key"].dataType.names, "_row.*").select(*schema.names)


def line_movement(feed: DataFrame, stamp: str, keys: Sequence[str], price: str, tie: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """First, last, lowest and highest price per key and time window; late rows are dropped."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    order = F.struct(stamp, tie)
    return (
        feed.withWatermark(stamp, late)
        .groupBy(w.alias("w"), *keys)
        .agg(
            F.min_by(price, order).alias("first_price"), F.max_by(price, order).alias("last_price"),
            F.min(price).alias("lowest_price"), F.max(price).alias("highest_price"), F.count("*").alias("snapshots"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "first_price", "last_price", "lowest_price", "highest_price", "snapshots")
    )


def without_repeats(feed: DataFrame, stamp: str, keys: Sequence[str], late: str) -> DataFrame:
    """First sighting of each snapshot; state is forgotten once it is older than ``late``."""
    return feed.withWatermark(stamp, late).dropDuplicatesWithinWatermark(list(keys))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all input that is there and read what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint-{uuid.uuid4().hex}")
        .outputMode("append").trigger(availableNow=True).start()
    )
    _finish(query)
    return spark.read.schema(stream.schema).parquet(out)
