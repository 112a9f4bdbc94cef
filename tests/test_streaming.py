"""Streaming forms against their batch twins."""

import pytest
from pyspark.sql import functions as F

from loomlake.operators import events
from loomlake.streaming import alerts

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def run(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_limiter(spark, stream):
    rows, live = stream
    got = {r.event_id: r.allowed for r in run(alerts.limited(live, "user_id", 3, 86400), "limited").collect()}
    batch = events.ordered_fold(rows.withColumn("micros", events.micros(F.col("ts"))), "user_id", "micros", "event_id", events.sliding_window(3, 86400, False), [], "ok", "boolean")
    assert got == {r.event_id: r.ok for r in batch.collect()}


def test_windowed_alerts(spark, stream):
    rows, live = stream
    got = {(r.window.start, r.user_id, r.n) for r in run(alerts.windowed_alerts(live, "user_id", 86400, 43200, 3, "1 hour"), "windowed").collect()}
    batch = rows.groupBy(F.window("ts", "86400 seconds", "43200 seconds"), "user_id").agg(F.count("*").alias("n")).where("n >= 3").collect()
    assert got and got <= {(r.window.start, r.user_id, r.n) for r in batch}
