"""A stored lexical index: postings in blocks of neighbouring rows with their largest impact, and searches that skip blocks by it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored

K1, B = 1.2, 0.75
TOKEN = re.compile(r"\w{2,}")
WIDTH, PARTS, PROBES = 8, 64, 32
PIECE = 1 << 20  # bytes of text whose counts a worker holds at a time
SLACK = 1e-9  # relative; sums of doubles in another order differ by far less


def _counts(text: str | None) -> Counter:
    return Counter(TOKEN.findall(text.lower())) if text else Counter()


def _pieces(batches: Iterator[pa.RecordBatch], step: int = 1, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of batches (key, text), of whole steps of rows: as many as hold `most` bytes of text, one at least. So what a
    worker makes of a slice is bounded by its texts and not by how many rows come in a batch."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        lo = held = 0
        for at in range(0, batch.num_rows, step):
            held, before = held + int(size[at : at + step].sum()), held
            if before and held > most:
                yield batch.slice(lo, at - lo)
                lo, held = at, held - before
        if lo < batch.num_rows:
            yield batch.slice(lo)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        found = [_counts(t.as_py()) for t in batch.column(1)]
        at = np.repeat(np.arange(len(found)), [len(c) for c in found])
        terms, tfs = pa.array(chain.from_iterable(found), pa.string()), pa.array(chain.from_iterable(c.values() for c in found), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), terms, tfs], ["key", "term", "tf"])


def _kind(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def term_frequencies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, term, tf: the tokens of each row, counted within the row, so nothing is shuffled."""
    return docs.select(key, "text").mapInArrow(_frequencies, f"key {_kind(docs, key)}, term string, tf long").withColumnRenamed("key", key)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows and tokens of each batch."""
    for batch in batches:
        tokens = sum(len(TOKEN.findall(t.as_py().lower())) for t in batch.column(0) if t.is_valid)
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([tokens])], ["n", "tokens"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, avgdl: float) -> Iterator[pa.RecordBatch]:
    """block, term, keys, impacts, most of `width` rows at a time."""
    block = TaskContext.get().partitionId() << 32
    for batch in _pieces(batches, width):
        counted = [_counts(t.as_py()) for t in batch.column(1)]
        dl = np.array([sum(c.values()) for c in counted], np.float64)
        blocks, terms, sizes, rows, tfs = [], [], [], [], []
        for lo in range(0, len(counted), width):
            lists: dict[str, list[int]] = {}
            for i in range(lo, min(lo + width, len(counted))):
                for term in counted[i]:
                    lists.setdefault(term, []).append(i)
            for term, held in lists.items():
                rows += held
                tfs += [counted[i][term] for i in held]
            blocks += [block] * len(lists)
            terms += lists
            sizes += map(len, lists.values())
            block += 1
        if not terms:
            continue
        at, tf = np.array(rows), np.array(tfs, np.float64)
        impacts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / avgdl))
        bounds = np.cumsum([0, *sizes])
        lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (batch.column(0).take(pa.array(at)), pa.array(impacts))]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(terms, pa.string()), *lists, pa.array(np.maximum.reduceat(impacts, bounds[:-1]))], ["block", "term", "keys", "impacts", "most"])


def build(docs: DataFrame, path: str, key: str = "doc_id", width: int = WIDTH, parts: int = PARTS) -> None:
    """Writes the index of docs (key, text) to a folder: `blocks`, `terms` and `totals`.

    Rows are sorted by length, as texts of like lengths have like scores and so closer bounds. A block is up to `width`
    neighbouring rows of a partition and made in one task, so no posting list is ever gathered: a term has a row in each
    block that it occurs in, with its rows' keys, their impacts (the part of BM25 that does not depend on the query) and the
    largest of them. Rows lie by hash of the term, sorted by term, so a search reads the columns and row groups of its own
    terms. Texts are read twice, for their lengths first. Null texts are rows without tokens; null keys are not told apart.
    """
    counted = docs.select("text").mapInArrow(_lengths, "n long, tokens long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    totals = counted.select("n", F.coalesce(F.col("tokens") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("avgdl"), F.lit(parts).alias("parts"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    whole = docs.sparkSession.read.parquet(f"{path}/totals").first()
    rows = docs.select(key, "text").withColumn("_size", F.coalesce(F.length("text"), F.lit(0)))
    by_size = rows.repartitionByRange("_size", F.xxhash64(key)).sortWithinPartitions("_size", key).drop("_size")
    made = by_size.mapInArrow(partial(_blocks, width=width, avgdl=whole.avgdl), f"block long, term string, keys array<{_kind(docs, key)}>, impacts array<double>, most double")
    cut = made.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    writer = cut.repartition(parts, "part").sortWithinPartitions("part", "term", "block").write.mode("overwrite")
    (writer.partitionBy("part") if whole.avgdl else writer).parquet(f"{path}/blocks")  # folders of no rows would leave no schema
    read = docs.sparkSession.read.parquet(f"{path}/blocks")
    idf = lambda df: F.log((F.lit(whole.n) - df + 0.5) / (df + 0.5) + 1)
    terms = read.groupBy("part", "term").agg(F.sum(F.size("keys")).alias("df"), F.count("*").alias("blocks")).withColumn("idf", idf(F.col("df")))
    terms.write.mode("overwrite").parquet(f"{path}/terms")


def weights(spark: SparkSession, path: str, queries: DataFrame, key: str) -> DataFrame:
    """query, term, part, ordinal, weight: the terms of each query that the index has, in order; a term that is repeated counts as often."""
    asked = term_frequencies(queries, key).select(F.col(key).alias("query"), "term", F.col("tf").alias("times"))
    known = spark.read.parquet(f"{path}/terms").select("term", "part", "idf")
    return asked.join(known, "term").select("query", "term", "part", (F.col("times") * F.col("idf")).alias("weight"))


def _scores(blocks: DataFrame, asked: DataFrame, on: list[str], key: str) -> DataFrame:
    """query, key, score of all rows of the blocks that are asked for; a row's parts are added in the order of its terms, so equal rows have equal scores."""
    hits = blocks.join(asked, on).select("query", "term", F.inline(F.arrays_zip(F.col("keys").alias(key), F.col("impacts").alias("impact"))), "weight")
    named = hits.toDF("query", "term", key, "impact", "weight")
    parts = F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * F.col("impact")).alias("part"))))
    return named.groupBy("query", key).agg(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"]).alias("score"))


def _best(scores: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, query_key: str = "query", key: str = "doc_id", probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(query, key, rank, score of the k best rows of each query (query_key, text); query, blocks, read of the work done). Equal to a scan.

    No row of a block can score more than the sum of its terms' weights times their largest impacts there. These bounds come
    from the index without its postings. The `probes` most promising blocks of each query are scored first; the k-th best
    score so far is a floor under the result, and of the other blocks only those are read whose bound reaches it. `blocks`
    counts the postings blocks of the query's terms, `read` those that are read. Queries without a known term have no rows.
    """
    asked = stored(weights(spark, path, queries, query_key), "asked")
    index = spark.read.parquet(f"{path}/blocks")
    bounds = index.select("part", "term", "block", "most").join(asked, ["part", "term"]).groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.count("*").alias("lists"))
    bounds = stored(bounds, "bounds")
    promising = bounds.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))).where(F.col("_k") <= probes)
    terms = lambda chosen: chosen.select("query", "block").join(asked, "query")
    first = _best(_scores(index, terms(promising), ["part", "term", "block"], key), k, key)
    floor = first.where(F.col("rank") == k).select("query", (F.col("score") * (1 - SLACK)).alias("floor"))
    chosen = stored(bounds.join(floor, "query", "left").where("floor is null or bound >= floor").select("query", "block", "lists"), "chosen")
    found = _best(_scores(index, terms(chosen), ["part", "term", "block"], key), k, key).select("query", key, "rank", "score")
    work = bounds.groupBy("query").agg(F.sum("lists").alias("blocks")).join(chosen.groupBy("query").agg(F.sum("lists").alias("read")), "query")
    return found, work


def scored(spark: SparkSession, path: str, query: str, key: str = "doc_id") -> DataFrame:
    """key, score of every row that holds a term of one query; only the partitions of its terms are read, and of them the row groups."""
    asked = stored(weights(spark, path, spark.createDataFrame([("", query)], "query string, text string"), "query"), "asked")
    terms = [r.term for r in asked.collect()]
    index = spark.read.parquet(f"{path}/blocks")
    parts = [r.part for r in asked.select("part").distinct().collect()]
    return _scores(index.where(F.col("part").isin(parts) & F.col("term").isin(terms)), asked, ["part", "term"], key).select(key, "score")
