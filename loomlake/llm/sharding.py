"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, spread_join, table, without

SHARDS = 40
PARTS = 256  # parts of a shard, and of the groups of one size, in which rows are numbered


class _Tree:
    """A balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self, keys):
        self.random, self.root = random.Random(7), None
        for k in keys:
            self.add(k)

    def _split(self, t, key):
        """Nodes below key, and the others."""
        if t is None:
            return None, None
        if t[1] < key:
            low, high = self._split(t[3], key)
            return [t[0], t[1], t[2], low], high
        low, high = self._split(t[2], key)
        return low, [t[0], t[1], high, t[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[0] > b[0]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, key):
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [self.random.random(), key, None, None]), high)

    def take(self, size):
        """Removes and returns the least key with at least that capacity; None where there is none."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        t = high
        while t[2] is not None:
            t = t[2]
        _, high = self._split(high, (t[1][0], t[1][1] + 1))
        self.root = self._merge(low, high)
        return t[1]


Classes = list[tuple[int, int]]  # (size, number of groups of that size)
Runs = list[tuple[int, int, int]]  # (size, bin, number of groups of that size that go there)


def best_fit_decreasing(classes: Classes, capacity: int, bins: int | None = None) -> Runs | None:
    """Where groups go by falling size, each to the bin with the tightest room for it.

    Groups of one size are taken together: the bin that is tightest for one stays so until it has no room for another.
    bins: None opens a new bin when none has room (the packing of fewest bins by this rule); a number packs into so many
    bins, and gives None where that fails.
    """
    tree, runs, opened = _Tree((capacity, b) for b in range(bins or 0)), [], bins or 0
    for size, count in sorted(classes, reverse=True):
        while count:
            room = tree.take(size)
            if room is None:
                if bins is not None:
                    return None
                room, opened = (max(capacity, size), opened), opened + 1
            n = min(count, room[0] // size)
            runs.append((size, room[1], n))
            tree.add((room[0] - n * size, room[1]))
            count -= n
    return runs


def level_bins(classes: Classes, bins: int) -> Runs:
    """Groups packed by best-fit-decreasing into `bins` bins of near equal contents.

    A group above the fair share of what is left has a bin of its own. The others go into bins of the least capacity that
    doubling and halving its excess over the fair share finds, to a thousandth.
    """
    rest, runs, used = dict(classes), [], 0
    total = sum(size * n for size, n in classes)
    for size in sorted(rest, reverse=True):
        while rest[size] and used < bins - 1 and size * (bins - used) > total:
            runs.append((size, used, 1))
            rest[size] -= 1
            total -= size
            used += 1
        if rest[size]:
            break
    left = [(size, n) for size, n in rest.items() if n]
    if not left:
        return runs
    fair = -(-total // (bins - used))
    low, extra, found = fair - 1, 0, None
    while found is None:
        found, high = best_fit_decreasing(left, fair + extra, bins - used), fair + extra
        low, extra = (low, extra) if found is not None else (high, 2 * extra or 1)
    while (high - low) * 1000 > fair:
        middle = (low + high) // 2
        tried = best_fit_decreasing(left, middle, bins - used)
        low, high, found = (low, middle, tried) if tried is not None else (middle, high, found)
    return runs + [(size, b + used, n) for size, b, n in found]


def shard_documents(docs: DataFrame, shards: int = SHARDS, group: Column | None = None) -> DataFrame:
    """docs with size, law ('bytes'), shard and slot; documents of a group share a shard, and the shards' sizes are near equal.

    size: UTF-8 bytes of the text plus 16. group: by default the text, where null and empty are one group. A group is never
    divided, so a group above a shard's fair share fills a shard of its own. Every group is an item of the packing. What
    the driver packs is how many groups there are of each size, a row for each distinct size: fewer than the square root
    of twice all bytes, in practice as many as there are lengths of texts. slot numbers a shard's rows from 0 without
    gaps. Columns of docs with the names of the result, or of work columns (_group, _part, _nth, _base), give way. An
    empty table gives an empty result; repeated rows keep a row each.
    """
    docs = without(docs, "size", "law", "shard", "slot", "_group", "_part", "_nth", "_base")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    key = F.unhex(F.sha2(F.coalesce(F.col("text") if group is None else group.cast("string"), F.lit("")), 256))
    sized = docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")).withColumn("_group", key)
    groups = scratch.save(sized.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    sizes = groups.groupBy("bytes").count().toArrow()
    packed, at = level_bins(list(zip(*(sizes.column(c).to_pylist() for c in ("bytes", "count")))), shards), {}
    runs: dict[int, list[dict]] = {}
    for size, shard, n in packed:
        first = at.get(size, 0)
        at[size] = first + n
        runs.setdefault(size, []).append({"end": first + n, "shard": shard})
    kind = pa.list_(pa.struct([("end", pa.int64()), ("shard", pa.int32())]))
    where = spark.createDataFrame(pa.table({"bytes": pa.array(list(runs), pa.int64()), "runs": pa.array(list(runs.values()), kind), "copies": pa.array([at[x] for x in runs], pa.int64())}))
    parted = groups.withColumn("_part", F.pmod(F.xxhash64("_group"), F.lit(PARTS)).cast("int"))
    in_part = parted.groupBy("bytes", "_part").agg(F.count("*").alias("_n"))
    bases = in_part.withColumn("_base", F.sum("_n").over(Window.partitionBy("bytes").orderBy("_part")) - F.col("_n")).drop("_n")
    ranked = parted.withColumn("_nth", F.row_number().over(Window.partitionBy("bytes", "_part").orderBy("_group"))).join(bases, ["bytes", "_part"])
    rank = F.col("_base") + F.col("_nth") - 1
    dealt = spread_join(ranked.select("_group", "bytes", F.col("rows"), rank.alias("rank")), where, ["bytes"], groups.count())
    placed = scratch.save(dealt.select("_group", F.col("rows").alias("copies"), F.filter("runs", lambda r: r["end"] > F.col("rank"))[0]["shard"].alias("shard")), "placed")
    scratch.drop("groups")
    total = placed.agg(F.sum("copies")).first()[0] or 0
    dealt = spread_join(sized, placed, ["_group"], total).withColumn("_part", F.pmod(F.xxhash64("doc_id", "_group", F.lit(5)), F.lit(PARTS)).cast("int"))
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))  # shards * PARTS rows
    bases = counts.withColumn("_base", F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).select("shard", "_part", "_base")
    order = Window.partitionBy("shard", "_part").orderBy(F.asc_nulls_first("doc_id"), "size", "_group")
    return (
        dealt.withColumn("_nth", F.row_number().over(order))
        .join(bases, ["shard", "_part"])
        .withColumn("slot", (F.col("_base") + F.col("_nth") - 1).cast("long"))
        .withColumn("law", F.lit("bytes"))
        .select(*[f"`{c}`" for c in docs.columns], "size", "law", "shard", "slot")
    )


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32")))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
