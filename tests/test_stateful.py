"""Streams of limiters against their batch folds, and written resolutions that come twice or break off."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomlake.operators import events as E
from loomlake.operators.reports import resolve_alerts
from loomlake.streaming import resolutions as W
from loomlake.streaming.limiters import ROCKS, Breaker, Cooldown, FixedWindow, SlidingWindow, TokenBucket, judged

SF = "/root/testdata/sf0.001"
DAY = 86400
MACHINES = [
    (SlidingWindow(3, DAY), E.sliding_window(3, DAY, False)),
    (SlidingWindow(3, DAY, True), E.sliding_window(3, DAY, True)),
    (TokenBucket(3.0, 3.0 / DAY), E.token_bucket(3.0, 3.0 / DAY)),
    (FixedWindow(2, DAY), E.fixed_window(2, DAY)),
    (Breaker(5, 6 * 3600, 2), E.circuit_breaker(5, 6 * 3600, 2)),
    (Cooldown(DAY), E.cooldown(DAY)),
]


@pytest.mark.parametrize("live,batch", MACHINES, ids=lambda x: type(x).__name__)
def test_stream_equals_batch_over_restarts(spark, tmp_path, live, batch):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", (F.col("user_id") % 7).alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    rows = rows.orderBy("ts").limit(400).cache()
    pdf = rows.toPandas().sort_values("ts").reset_index(drop=True)
    late = spark.createDataFrame([(10**9, -1, datetime.datetime(2031, 1, 1), True)], rows.schema)

    def put(part, order):  # within a file and its neighbour rows come in any order
        spark.createDataFrame(part.sample(frac=1, random_state=order), rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = judged(stream, live, "user_id", "40 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        q = out.trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        cuts = [(i, pdf.iloc[i::2].iloc[h * 100 : h * 100 + 100]) for h in (0, 1) for i in (0, 1)]
        for k, (_, part) in enumerate(cuts[:2]):
            put(part, k)
        run()
        for k, (_, part) in enumerate(cuts[2:]):
            put(part, k)
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    inputs = ["ok"] if isinstance(live, Breaker) else []
    fold = E.ordered_fold(rows.withColumn("micros", E.micros(F.col("ts"))), "user_id", "micros", "event_id", batch, inputs, "answer", live.answer)
    got = spark.read.schema(f"user_id long, event_id long, answer {live.answer}").parquet(str(tmp_path / "out")).where("user_id >= 0").collect()
    assert len(got) == 400 and {(r.event_id, r.answer) for r in got} == {(r.event_id, r.answer) for r in fold.collect()}


@pytest.fixture
def alerts(spark, tmp_path):
    table = W.Snapshots(spark, str(tmp_path / "alerts"))
    first = spark.createDataFrame([(i, f"kind {i % 3}") for i in range(6)], "alert_id long, kind string")
    empty = first.selectExpr("*", "false AS resolved", "cast(null as string) AS notes", "cast(null as long) AS resolved_at")
    assert table.current() is None and table.read() is None
    table.swap(table.write(empty), -1)
    return table


def state(table):
    return sorted((r.alert_id, r.kind, r.resolved, r.notes, r.resolved_at) for r in table.read().collect())


def test_a_batch_twice_and_a_crash_change_nothing(spark, alerts, monkeypatch):
    given = lambda rows: spark.createDataFrame(rows, "alert_id long, notes string, at long")
    one, two = given([(1, "fixed", 5), (1, "again", 9), (77, "no such alert", 1)]), given([(1, "too late", 7), (2, "ok", 8), (3, None, 3)])
    assert W.resolve_into(alerts, one, 0)
    after = state(alerts)
    assert not W.resolve_into(alerts, one, 0) and state(alerts) == after
    assert [(r[0], r[2], r[3], r[4]) for r in after if r[2]] == [(1, True, "again", 9)]

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(W.Snapshots, "swap", stop)
        with pytest.raises(OSError):
            W.resolve_into(alerts, two, 1)
    assert state(alerts) == after
    assert W.resolve_into(alerts, two, 1) and not W.resolve_into(alerts, two, 1)
    whole = resolve_alerts(spark.createDataFrame([(i, f"kind {i % 3}") for i in range(6)], "alert_id long, kind string"), one.unionByName(two))
    assert [r[:4] for r in state(alerts)] == sorted((r.alert_id, r.kind, r.resolved, r.notes) for r in whole.collect())


def test_resolutions_of_a_stream(spark, alerts, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(i, f"note {i}", i)], "alert_id long, notes string, at long").coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second time the checkpoint is gone and every batch comes again
        live = spark.readStream.schema("alert_id long, notes string, at long").option("maxFilesPerTrigger", 1).parquet(source)
        q = W.resolving(live, alerts.path).option("checkpointLocation", str(tmp_path / f"check{_}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert [(r[0], r[3]) for r in state(alerts) if r[2]] == [(i, f"note {i}") for i in range(3)]
