"""Limiters, breakers and cooldowns over streams: each key's rows are judged in the order of their times, however they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import MICROS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class SlidingWindow:
    """Denied requests are not recorded; `inclusive` keeps a request exactly one window old."""

    limit: int
    window: int
    inclusive: bool = False
    schema = "kept array<long>"
    answer = "boolean"

    @property
    def idle(self) -> int:
        return self.window

    def start(self) -> tuple:
        return ([],)

    def step(self, state: tuple, t: int, ok: bool) -> tuple[tuple, bool]:
        low = t - self.window * MICROS
        kept = [x for x in state[0] if x > low or self.inclusive and x == low]
        return ((kept,), False) if len(kept) >= self.limit else (([*kept, t],), True)


@dataclass(frozen=True)
class TokenBucket:
    """`refill` tokens a second up to `capacity`; a request takes one."""

    capacity: float
    refill: float
    schema = "tokens double, at long"
    answer = "boolean"

    @property
    def idle(self) -> int:
        return int(self.capacity / self.refill) + 1

    def start(self) -> tuple:
        return (self.capacity, None)

    def step(self, state: tuple, t: int, ok: bool) -> tuple[tuple, bool]:
        tokens = state[0] if state[1] is None else min(self.capacity, state[0] + (t - state[1]) / MICROS * self.refill)
        return ((tokens - 1, t), True) if tokens >= 1 else ((tokens, t), False)


@dataclass(frozen=True)
class FixedWindow:
    """A window starts at a key's first request and at the first one after it ended."""

    limit: int
    window: int
    schema = "begun long, n long"
    answer = "boolean"

    @property
    def idle(self) -> int:
        return self.window

    def start(self) -> tuple:
        return (None, 0)

    def step(self, state: tuple, t: int, ok: bool) -> tuple[tuple, bool]:
        begun, n = (t, 0) if state[0] is None or t - state[0] >= self.window * MICROS else state
        return ((begun, n), False) if n >= self.limit else ((begun, n + 1), True)


@dataclass(frozen=True)
class Cooldown:
    """Whether an alert is sent: the first is, and each one more than `seconds` after the last that was."""

    seconds: int
    schema = "last long"
    answer = "boolean"

    @property
    def idle(self) -> int:
        return self.seconds + 1

    def start(self) -> tuple:
        return (None,)

    def step(self, state: tuple, t: int, ok: bool) -> tuple[tuple, bool]:
        return ((t,), True) if state[0] is None or t - state[0] > self.seconds * MICROS else (state, False)


@dataclass(frozen=True)
class Breaker:
    """State after each call. Failures are counted over the key's life, so its state is never given up; a call on an open breaker before the timeout is rejected."""

    failures: int = 5
    timeout: int = 60
    successes: int = 2
    schema = "state string, failed long, good long, opened long"
    answer = "string"
    idle = None

    def start(self) -> tuple:
        return ("closed", 0, 0, 0)

    def step(self, state: tuple, t: int, ok: bool) -> tuple[tuple, str]:
        now, failed, good, opened = state
        if now == "open":
            if t - opened < self.timeout * MICROS:
                return state, "rejected"
            now, good = "half_open", 0
        if ok and now == "half_open":
            good += 1
            now = "closed" if good >= self.successes else now
        elif not ok:
            failed += 1
            if now == "half_open" or failed >= self.failures:
                now, opened = "open", t
        return (now, failed, good, opened), now


class InOrder(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then judges them in the order of time and id.

    A timer stands at the earliest row that waits. When nothing waits any more, a timer stands where the machine would be
    back in its first state, and the key's state is given up there; so keys at rest cost nothing.
    """

    def __init__(self, machine, key: str):
        self.machine, self.key = machine, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", self.machine.schema)
        self.last = handle.getValueState("last", "micros long")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, ok boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i), bool(ok)) for batch in rows for t, i, ok in zip(batch["micros"], batch["event_id"], batch["ok"])]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if ready:
            state, told = tuple(self.state.get()) if self.state.exists() else self.machine.start(), []
            for t, i, ok in ready:
                state, answer = self.machine.step(state, t, ok)
                told.append((key[0], i, answer))
            self.state.update(state)
            self.last.update((ready[-1][0],))
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame(told, columns=[self.key, "event_id", "answer"])
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif self.machine.idle is not None and self.last.exists():
            end = self.last.get()[0] + self.machine.idle * MICROS
            if end < passed:
                self.state.clear()
                self.last.clear()
            else:
                self.handle.registerTimer(end // 1000 + 1)

    def close(self) -> None:
        pass


def judged(events: DataFrame, machine, key: str, delay: str = "1 hour") -> DataFrame:
    """key, event_id, answer of a machine for each row of a stream (key, event_id, ts, ok), once the watermark, `delay` behind the latest row, has passed it.

    The answers are those of the batch fold over all rows, whatever the triggers and the order of arrival within the delay;
    later rows are dropped by Spark. A key's state is its machine's numbers and the rows of the delay. The session's state
    store must be RocksDB (ROCKS). Null keys are a key of their own.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select(key, "event_id", "ok", "ts", F.unix_micros("ts").alias("micros"))
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(InOrder(machine, key), f"{key} {kind}, event_id long, answer {machine.answer}", "append", "EventTime")
