"""Streams give what the batch form gives, also when late files bring old rows."""

from pyspark.sql import functions as F

from scoutframe.operators.windows import latest_per_key
from scoutframe.sources.tables import scratch_path
from scoutframe.streaming import feeds as R


def test_latest_state_equals_batch_with_late_rows(spark):
    rows = [(f"k{i % 7}", (i * 37) % 101, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    path, state = scratch_path(spark, "feed"), scratch_path(spark, "state")
    df.repartition(5).write.parquet(path)
    feed = R.file_feed(spark, path, df.schema, files_per_trigger=1)
    R.keep_latest(feed, state, scratch_path(spark, "cp"), ["k"], ["t", "v"]).awaitTermination()
    got = {tuple(r) for r in R.newest_version(spark, state, df.schema).collect()}
    assert got == {tuple(r) for r in latest_per_key(df, ["k"], ["t", "v"]).collect()}


def test_open_window_is_not_emitted(spark):
    df = spark.createDataFrame([(1, "2024-01-01 01:00:00", 5), (2, "2024-01-02 01:00:00", 6), (3, "2024-01-03 05:00:00", 7)], "id int, t string, p int")
    df = df.withColumn("t", F.col("t").cast("timestamp"))
    path = scratch_path(spark, "feed")
    df.coalesce(1).write.parquet(path)
    out = R.run_to_table(R.line_movement(R.file_feed(spark, path, df.schema), "t", [], "p", "id", "1 day", "1 hour"), "out")
    assert [r["first_price"] for r in out.orderBy("window_start").collect()] == [5, 6]


def test_restart_goes_on_from_the_state_and_writes_touched_keys_only(spark):
    path, state, changes = (scratch_path(spark, n) for n in ("feed", "state", "changes"))
    first = spark.createDataFrame([(f"k{i}", i, i) for i in range(500)], "k string, t int, v int")
    first.coalesce(1).write.parquet(path)

    def run():
        R.keep_latest(R.file_feed(spark, path, first.schema), state, changes, ["k"], ["t", "v"]).awaitTermination()

    run()
    later = spark.createDataFrame([("k3", 900, -1), ("k499", 0, -2), ("new", 1, 7)], first.schema)
    later.coalesce(1).write.mode("append").parquet(path)
    run()
    written = {r["batch"]: r["count"] for r in spark.read.parquet(changes).groupBy("batch").count().collect()}
    assert written == {0: 500, 1: 3}
    got = {r["k"]: (r["t"], r["v"]) for r in R.newest_version(spark, state, first.schema).collect()}
    assert len(got) == 501 and got["k3"] == (900, -1) and got["k499"] == (499, 499) and got["new"] == (1, 7)
