"""A stored index of the three-letter runs of texts, for LIKE patterns without regard to case; it gives candidates, which the pattern then confirms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import stored, write_parts

WIDTH = 64  # rows of a block: one bit each of a long
PARTS, RAREST, PUSHED = 64, 8, 10_000


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, gram, mask of WIDTH rows at a time: the bits of the rows that hold the gram; the gram '' has `keys`, those of all rows."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo in range(0, batch.num_rows, WIDTH):
            part = batch.slice(lo, WIDTH)
            masks: dict[str, int] = {}
            for i, text in enumerate(part.column(1)):
                t, bit = text.as_py() or "", 1 << i
                for g in set(map("".join, zip(t, t[1:], t[2:]))):
                    masks[g] = masks.get(g, 0) | bit
            bits = np.array(list(masks.values()), np.uint64).view(np.int64)
            keys = pa.array([part.column(0).to_pylist()] + [None] * len(masks), pa.list_(part.schema.field(0).type))
            yield pa.RecordBatch.from_arrays([pa.array([block] * (len(masks) + 1), pa.int64()), pa.array(["", *masks], pa.string()), pa.array(np.append(np.int64(-1), bits)), keys], ["block", "gram", "mask", "keys"])
            block += 1


def build(docs: DataFrame, path: str, key: str = "doc_id", parts: int = PARTS) -> None:
    """Writes the index of docs (key, text) to a folder: `grams` (part, gram, block, mask), `blocks` (block, keys) and `counts` (gram, blocks).

    Blocks are made in the task that reads the rows, so nothing is gathered by gram; rows are then dealt by hash of the gram
    and sorted, so that a search reads the row groups of its own grams. Null texts hold no gram.
    """
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, F.lower("text").alias("text")).mapInArrow(_grams, f"block long, gram string, mask long, keys array<{kind}>")
    made = stored(made.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")), "grams")
    made.where("gram = ''").select("block", "keys").write.mode("overwrite").parquet(f"{path}/blocks")
    grams = made.where("gram != ''").select("gram", "block", "mask", "part")
    write_parts(grams.repartition(parts, "part").sortWithinPartitions("part", "gram", "block"), f"{path}/grams", "part")
    grams.groupBy("part", "gram").agg(F.count("*").alias("blocks")).write.mode("overwrite").parquet(f"{path}/counts")


def grams_of(pattern: str) -> list[str]:
    """The runs of three characters that every text like the pattern holds: those without a wildcard between. A backslash takes the next character as it is."""
    parts, escaped = [""], False
    for c in pattern:
        if escaped:
            parts[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            parts.append("")
        else:
            parts[-1] += c
    return list(dict.fromkeys(p[i : i + 3] for p in parts for i in range(len(p) - 2)))


def _lowered(spark: SparkSession, pattern: str) -> str:
    return spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first().p


def candidates(spark: SparkSession, path: str, pattern: str, key: str = "doc_id") -> DataFrame | None:
    """key of the rows that hold all of the pattern's rarest grams; None for a pattern without a gram, for which every row is a candidate.

    Up to RAREST grams count, those in the fewest blocks first; their masks are intersected by block.
    """
    grams = grams_of(_lowered(spark, pattern))
    if not grams:
        return None
    counts = spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).orderBy("blocks", "gram").collect()
    keys = spark.read.parquet(f"{path}/blocks")
    if len(counts) < len(grams):  # some gram stands nowhere
        return keys.where("false").select(F.explode("keys").alias(key))
    rarest = counts[:RAREST]
    index = spark.read.parquet(f"{path}/grams").where(F.col("part").isin(sorted({r.part for r in rarest})) & F.col("gram").isin([r.gram for r in rarest]))
    hits = index.groupBy("block").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("n")).where((F.col("n") == len(rarest)) & (F.col("mask") != 0))
    held = F.filter(F.transform("keys", lambda k, i: F.when(F.getbit("mask", i) == 1, F.struct(k.alias("k")))), lambda x: x.isNotNull())
    return keys.join(hits, "block").select(F.inline(held)).toDF(key)


def like(spark: SparkSession, text: Column, pattern: str) -> Column:
    """text ILIKE pattern, in time linear in the text. The parts between percent signs are searched from left to right, each
    at the first place after the one before, and none is given back: a later place would only leave less for the rest. A
    plain LIKE with several parts tries all places of each again, so that a text of n characters costs a power of n.
    """
    if pattern.count("%") < 3 or "\\" in pattern:
        return F.ilike(text, F.lit(pattern))
    pattern = _lowered(spark, pattern)
    part = lambda p: "".join("." * len(list(g)) if wild else "\\Q" + "".join(g) + "\\E" for wild, g in groupby(p, lambda c: c == "_"))
    first, *middle, last = map(part, pattern.split("%"))
    regex = r"(?s)\A" + first + "".join(f"(?>.*?{p})" for p in middle if p) + (rf".*{last}\z" if last else "")
    return F.rlike(F.lower(text), F.lit(regex))


def ilike(docs: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """The rows of docs (key, text, and more columns) whose text is like the pattern, letters in either case. Equal to a scan.

    Up to PUSHED candidates go to the reader as a list, which skips the row groups and pages without them; more are joined.
    Rows whose key is null are always compared.
    """
    confirmed = like(docs.sparkSession, F.col("text"), pattern)
    found = candidates(docs.sparkSession, path, pattern, key)
    if found is None:
        return docs.where(confirmed)
    found = stored(found.where(F.col(key).isNotNull()), "candidates")
    few = [r[0] for r in found.limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:
        return docs.where((F.col(key).isin(few) | F.col(key).isNull()) & confirmed)
    return docs.join(found.distinct(), key, "left_semi").where(confirmed).unionByName(docs.where(F.col(key).isNull() & confirmed))
