"""Structured Streaming forms of the event operators. The watermark's delay is a parameter; later rows are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import MICROS


def windowed_alerts(events: DataFrame, key: str, seconds: int, slide: int, least: int, delay: str = "10 minutes") -> DataFrame:
    """window, key, n of the sliding windows in which a key has `least` rows or more. events: ts (timestamp) and the key."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counted = timed.groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds"), key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def limited(events: DataFrame, key: str, limit: int, window: int) -> DataFrame:
    """key, event_id, allowed by a sliding window that forgets denied requests, for rows with ts and event_id.

    A key's state is the times of its allowed requests within the window, `limit` of them at most. Rows of one trigger are
    taken in the order of their times; a row older than what an earlier trigger allowed is judged as of its own time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for batch in batches:
            batch = batch.sort_values(["micros", "event_id"])
            allowed = []
            for t in batch["micros"]:
                kept = [x for x in kept if x > t - window * MICROS]
                allowed.append(len(kept) < limit)
                if allowed[-1]:
                    kept.append(int(t))
            yield pd.DataFrame({key: batch[key], "event_id": batch["event_id"], "allowed": allowed})
        state.update((kept,))

    kind = dict(events.dtypes)[key]
    rows = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, allowed boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)
