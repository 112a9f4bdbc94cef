"""Storage tiers by how often a key is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

# Relative cost per byte and relative latency of each tier, moves of a run and of a batch.
COST = {"hot": 1.0, "warm": 0.5, "cold": 0.1, "archive": 0.05}
LATENCY = {"hot": 1.0, "warm": 5.0, "cold": 50.0, "archive": 200.0}
MOVES, BATCH = 1000, 50
TARGET = {"frequent": "hot", "moderate": "warm", "rare": "cold", "archive": "archive"}


def frequency(n: Column) -> Column:
    return F.when(n == 0, "archive").when(n < 2, "rare").when(n < 10, "moderate").otherwise("frequent")


def lookup(value: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value)


def access_frequency(log: DataFrame, key: str, time: str, now, days: int = 30) -> DataFrame:
    """key, n_recent, last, frequency from an access log; `now` is a timestamp column or literal."""
    recent = F.col(time) >= now - F.expr(f"interval {days} days")
    out = log.groupBy(key).agg(F.count_if(recent).alias("n_recent"), F.max(time).alias("last"))
    return out.withColumn("frequency", frequency(F.col("n_recent")))


def plan(usage: DataFrame, now, rest_days: int = 7) -> DataFrame:
    """Moves of (key, tier, size, n_recent, last, frequency): what was used in the last rest_days stays, as does what is in its tier."""
    target = lookup(F.col("frequency"), TARGET)
    moved = usage.where(F.col("last") < now - F.expr(f"interval {rest_days} days")).withColumn("target", target).where("target != tier")
    return moved.withColumn("saving", F.col("size") * (lookup(F.col("tier"), COST) - lookup(F.col("target"), COST)))


def savings(moves: DataFrame) -> DataFrame:
    """tier, target, moves, size, saving of a plan, by the tiers between which it moves."""
    return moves.groupBy("tier", "target").agg(F.count("*").alias("moves"), F.sum("size").alias("size"), F.round(F.sum("saving"), 6).alias("saving"))


def batches(moves: DataFrame, key: str, most: int = MOVES, size: int = BATCH) -> DataFrame:
    """Moves of one run: rank, batch (from 1) and latency_gain of the `most` moves that save most, in batches of `size`; ties go by key."""
    gain = lookup(F.col("tier"), LATENCY) - lookup(F.col("target"), LATENCY)
    ranked = numbered(moves.withColumn("latency_gain", gain), [F.desc(F.round("saving", 6)), F.asc(key)])
    return ranked.where(F.col("rank") <= most).withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int") + 1)


def retention(backups: DataFrame, created: str, now, keep: dict[str, int] | None = None) -> DataFrame:
    """backups with age_class and expired: what is older than a day, week, month or year goes while there are more backups in all
    than the class keeps. `now` is a timestamp column or literal."""
    keep = keep or {"daily": 7, "weekly": 4, "monthly": 12, "yearly": 3}
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    name = F.when(age > 365, "yearly").when(age > 30, "monthly").when(age > 7, "weekly").when(age > 1, "daily")
    total = backups.agg(F.count("*").alias("_total"))
    aged = backups.withColumn("age_class", name).join(total)
    return aged.withColumn("expired", F.coalesce(F.col("_total") > lookup(F.col("age_class"), keep), F.lit(False))).drop("_total")
