import tempfile

from pyspark.sql import functions as F
from quarryline.streaming import events as ev

SF = "/root/testdata/sf0.001"


def stream(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    batch.repartition(3).write.mode("append").parquet(folder)
    return batch, spark.readStream.schema(batch.schema).parquet(folder)


def finished(spark, frame, name, mode="complete"):
    ev.run_to_table(frame, name, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), mode).awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_tumbling_stream_equals_batch(spark):
    batch, live = stream(spark)
    assert finished(spark, ev.tumbling(live), "tumbled") == {tuple(r) for r in ev.tumbling(batch).collect()}


def test_late_duplicates_are_dropped(spark):
    batch, live = stream(spark)
    assert len(finished(spark, ev.distinct_events(live).select("event_id"), "once", "append")) == batch.select("event_id").distinct().count()


def test_stream_joins_a_snapshot(spark):
    batch, live = stream(spark)
    users = spark.read.parquet(f"{SF}/customer.parquet")
    assert finished(spark, ev.enriched(live, users), "enriched_events", "append") == {tuple(r) for r in ev.enriched(batch, users).collect()}


def test_sessions_close_after_the_gap(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 00:00:00")]
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "event_id int, user_id int, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted((r["user_id"], r["n"]) for r in ev.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]
