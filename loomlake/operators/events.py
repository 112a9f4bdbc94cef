"""Event analytics: limiters, alerts, breakers.

Limiters that forget denied requests depend on the order of all earlier decisions, so no window function gives them.
`ordered_fold` runs them as a state machine over rows sorted by key and time, in batches: the state of a key is what the
limiter itself keeps, and no key's rows are ever gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stretches(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """df with `_stretch`: a number that rises whenever more than `gap` seconds lie between two rows of a key.

    Buckets of time as wide as the gap take the place of a window over the whole key: a stretch is a run of buckets that
    follow one another, so only the distinct buckets of a key, not its rows, come together.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(time) / (gap * MICROS)))
    seen = bucketed.groupBy(key, "_bucket").count()
    first = F.coalesce(F.col("_bucket") - F.lag("_bucket").over(Window.partitionBy(key).orderBy("_bucket")) > 2, F.lit(True))
    named = seen.withColumn("_stretch", F.sum(first.cast("int")).over(Window.partitionBy(key).orderBy("_bucket"))).select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), "_stretch")
    return bucketed.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))).drop("_bucket", "_k", "_b")


def ordered_fold(df: DataFrame, key: str, time: str, tie: str, machine: Callable[[], Callable], inputs: list[str], name: str, kind: str, gap: int | None = None) -> DataFrame:
    """df's key, tie and time with the machine's answer for each row. machine() makes a fresh step(time, *inputs) -> answer for each key.

    gap: so many seconds without a row bring the machine back to its first state; a key's rows are then dealt by the
    stretches between such gaps, so a key that is never at rest is the only one that stays in one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = object(), None
        for batch in batches:
            answers = []
            for k, part, t, *values in zip(batch[key], batch["_stretch"], batch[time], *[batch[c] for c in inputs]):
                k = None if pd.isna(k) else k
                if (k, part) != current:
                    current, step = (k, part), machine()
                answers.append(step(t, *values))
            yield batch[[key, tie, time]].assign(**{name: answers})

    kinds = dict(df.dtypes)
    parted = stretches(df, key, time, gap) if gap else df.withColumn("_stretch", F.lit(0))
    rows = parted.select(key, "_stretch", tie, time, *inputs).repartition(key, "_stretch").sortWithinPartitions(key, "_stretch", time, tie)
    return rows.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {time} {kinds[time]}, {name} {kind}")


def cooldown(seconds: int) -> Callable[[], Callable]:
    """Whether an alert is sent: the first is, and each one more than `seconds` after the last that was."""

    def machine():
        last = [None]

        def step(t):
            if last[0] is None or t - last[0] > seconds * MICROS:
                last[0] = t
                return True
            return False

        return step

    return machine


def sliding_window(limit: int, window: int, inclusive: bool) -> Callable[[], Callable]:
    """Denied requests are not recorded; `inclusive` keeps a request exactly one window old."""

    def machine():
        kept = deque()

        def step(t):
            low = t - window * MICROS
            while kept and (kept[0] < low or not inclusive and kept[0] == low):
                kept.popleft()
            if len(kept) >= limit:
                return False
            kept.append(t)
            return True

        return step

    return machine


def token_bucket(capacity: float, refill: float) -> Callable[[], Callable]:
    """`refill` tokens a second up to `capacity`; a request takes one."""

    def machine():
        state = [capacity, None]

        def step(t):
            if state[1] is not None:
                state[0] = min(capacity, state[0] + (t - state[1]) / MICROS * refill)
            state[1] = t
            if state[0] >= 1:
                state[0] -= 1
                return True
            return False

        return step

    return machine


def fixed_window(limit: int, window: int) -> Callable[[], Callable]:
    """A window starts at a key's first request and at the first one after it ended."""

    def machine():
        state = [None, 0]

        def step(t):
            if state[0] is None or t - state[0] >= window * MICROS:
                state[:] = [t, 0]
            if state[1] >= limit:
                return False
            state[1] += 1
            return True

        return step

    return machine


def circuit_breaker(failures: int = 5, timeout: int = 60, successes: int = 2) -> Callable[[], Callable]:
    """State after each call, from (time, ok). Failures are counted over the key's life; a call on an open breaker before the timeout is rejected."""

    def machine():
        state = {"is": "closed", "failed": 0, "good": 0, "opened": 0}

        def step(t, ok):
            if state["is"] == "open":
                if t - state["opened"] < timeout * MICROS:
                    return "rejected"
                state.update({"is": "half_open", "good": 0})
            if ok:
                if state["is"] == "half_open":
                    state["good"] += 1
                    if state["good"] >= successes:
                        state["is"] = "closed"
            else:
                state["failed"] += 1
                if state["is"] == "half_open" or state["failed"] >= failures:
                    state.update({"is": "open", "opened": t})
            return state["is"]

        return step

    return machine


def trailing_count(df: DataFrame, keys: list[str], seconds: int, name: str, time: str = "micros") -> DataFrame:
    """df with the number of its rows of the key in the `seconds` up to each row, the lower end left out.

    Rows are dealt by key and by stretch of `seconds`; a stretch also gets the times of the one before it, which is as far
    as a window reaches. So a key with most of the rows is spread over as many tasks as there are stretches.
    """
    stretch = F.floor(F.col(time) / (seconds * MICROS))
    own = df.withColumn("_stretch", stretch).withColumn("_own", F.lit(True))
    before = df.select(*keys, time, (stretch + 1).alias("_stretch"), F.lit(False).alias("_own"))
    w = Window.partitionBy(*keys, "_stretch").orderBy(time).rangeBetween(-seconds * MICROS + 1, 0)
    return own.unionByName(before, allowMissingColumns=True).withColumn(name, F.count("*").over(w)).where("_own").drop("_own", "_stretch")


def previous(df: DataFrame, key: str, order: list[str], value: str, name: str, stretch: Column) -> DataFrame:
    """df with the value of the key's row before, in the given order; null for the first.

    stretch: a number that never falls in that order. Rows are dealt by key and stretch; the first row of a stretch takes
    the last one of the key's stretch before, of which there is one row each.
    """
    dealt = df.withColumn("_stretch", stretch)
    last = dealt.groupBy(key, "_stretch").agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias("_v"))
    carried = last.withColumn("_carried", F.lag("_v").over(Window.partitionBy(key).orderBy("_stretch"))).select(F.col(key).alias("_k"), F.col("_stretch").alias("_s"), "_carried")
    inside = dealt.withColumn("_inside", F.lag(value).over(Window.partitionBy(key, "_stretch").orderBy(*order)))
    joined = inside.join(carried, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s")), "left")
    return joined.withColumn(name, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_stretch", "_k", "_s")


def threshold_alerts(df: DataFrame, keys: list[str], seconds: int, least: int, time: str = "micros") -> DataFrame:
    """keys, alerts, worst: the keys whose count within a window reaches `least`, how many rows did so, and the largest count."""
    counted = trailing_count(df, keys, seconds, "n", time).where(F.col("n") >= least)
    return counted.groupBy(*keys).agg(F.count("*").alias("alerts"), F.max("n").alias("worst"))


def limits(df: DataFrame, dimensions: dict[str, tuple[Column, int, int]], time: str = "micros") -> DataFrame:
    """df with allowed, remaining and denied_by: trailing counts of several keys at once, each {name: (key, limit, seconds)}.
    The first dimension over its limit denies; a null key is not limited in its dimension."""
    left, denied = [], []
    for name, (key, limit, seconds) in dimensions.items():
        df = trailing_count(df.withColumn(f"{name}_key", key), [f"{name}_key"], seconds, f"{name}_n", time)
        free = F.when(F.col(f"{name}_key").isNotNull(), F.greatest(limit - F.col(f"{name}_n"), F.lit(0)))
        left.append(free)
        denied.append(F.when(F.col(f"{name}_key").isNotNull() & (F.col(f"{name}_n") > limit), name))
    by = F.coalesce(*denied)
    out = df.withColumn("denied_by", by).withColumn("allowed", by.isNull())
    out = out.withColumn("remaining", F.when(by.isNotNull(), 0).otherwise(F.least(*left) if len(left) > 1 else left[0]))
    return out.drop(*[f"{n}{x}" for n in dimensions for x in ("_key", "_n")])
