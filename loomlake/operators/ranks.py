"""Exact ranks of large or hot keys: rows are dealt by range, so that no key's values are sorted in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored


def _dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, with the number of each row's range in `_part`; stored, so that both stay as they are."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def _bases(parts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """parts (keys, _part, size) with _base, the sizes of the key's parts before, and n, those of all. A key has at most as many parts as there are ranges."""
    by_key = Window.partitionBy(*keys)
    return parts.withColumn("_base", F.sum(size).over(by_key.orderBy("_part")) - F.col(size)).withColumn("n", F.sum(size).over(by_key))


def floor_percentiles(df: DataFrame, keys: list[str], value: str, percents: dict[str, float], offset: int = 1) -> DataFrame:
    """keys, n and one column per name: the value at index floor((n - offset) * p) of the key's sorted values that are not null.

    Equal values of a key are counted before the shuffle. The distinct values are dealt by range of (keys, value), so a hot
    key lies in many ranges; sums of the ranges say which one holds a rank, and only that one's values are added up.
    """
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        return floor_percentiles(rows.withColumn("_all", F.lit(1)), ["_all"], value, percents, offset).drop("_all")
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = _dealt(counts, *keys, value)
    based = _bases(placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_size")), keys, "_size")
    index = lambda p: F.least(F.floor((F.col("n") - offset) * F.lit(p)), F.col("n") - 1)
    asked = based.select(*keys, "_part", "_base", "_size", "n", F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), index(p).alias("_rank")) for name, p in percents.items()])))
    asked = asked.where((F.col("_rank") >= F.col("_base")) & (F.col("_rank") < F.col("_base") + F.col("_size")))
    asked = asked.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_base", "n", "_name", "_rank")
    here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))
    held = placed.join(asked, here, "left_semi").withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(value)))
    found = held.join(asked, here).where(F.col("_base") + F.col("_upto") > F.col("_rank"))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in percents])


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's number from 1 in the order, over the whole table: ranges of the order are numbered apart and moved up by what lies before."""
    placed = _dealt(df, *order)
    sizes = placed.groupBy("_part").count()
    bases = sizes.withColumn("_base", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, within).join(bases, "_part").withColumn(name, (F.col("_base") + F.col(name)).cast("long")).drop("_part", "_base")
