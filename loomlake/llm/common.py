"""What the training-data operators share: the word pattern, table reading, row keys and intermediate tables."""

from __future__ import annotations

import secrets
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the checkpoint folder that is set.

    Only on one machine (tests) a temporary folder is set where there is none; on a cluster that is an error, as each
    executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not (spark.conf.get("spark.master", None) or spark.sparkContext.master).startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomlake-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder: they cut lineage and survive the loss of executors.

    save() runs the plan and returns the stored table; the shuffle files of that run are then of no more use, and Spark is
    told to remove them. drop() deletes a table that no later plan reads. Tables that the returned frame still reads stay
    in the shared folder, which the cluster's owner empties.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without the columns that have the name of a result column or of a work column, in any case: the operator's own columns win."""
    taken = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with the columns of these names (in any case) under other names, and the columns that give docs back as it was."""
    taken = {n.lower() for n in names}
    new = [f"_own_{c}" if c.lower() in taken else c for c in docs.columns]
    return docs.toDF(*new), [F.col(f"`{n}`").alias(c) for n, c in zip(new, docs.columns)]


def secret() -> int:
    """A key for the hashes of one operator call; equal in all its tasks, and not known to who wrote the texts."""
    return secrets.randbits(63)


HEAVY = 1024


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined with right (a row per key, `copies`: how many rows of left have it), so that no key gathers in one task.

    Keys with more than total / HEAVY rows, of which there are fewer than HEAVY however large the input is, are broadcast
    and their rows stay where they are; the others are joined by a shuffle. total: the rows of left. right loses `copies`.
    """
    heavy = F.broadcast(right.where(F.col("copies") * HEAVY > total).drop("copies"))
    light = right.where(F.col("copies") * HEAVY <= total).drop("copies")
    return left.join(heavy, keys).unionByName(left.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how))


def keyed(docs: DataFrame, scratch: Scratch, *more: str) -> tuple[DataFrame, bool]:
    """doc_id, text, `more` columns and rid, a long that is unique by row and ordered as doc_id; and whether rid is doc_id.

    Where doc_id is whole-numbered, never null and unique, rid is doc_id. Else rows are numbered in the order of doc_id
    (nulls first), then text, then `more`, so that repeated ids and repeated rows remain rows of their own.
    """
    names = [f"`{c}`" for c in ("doc_id", "text", *more)]
    thin = docs.select(*names)
    if dict(thin.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        odd = thin.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1)
        if odd.isEmpty():
            return thin.withColumn("rid", F.col("doc_id").cast("long")), True
    order = [F.asc_nulls_first(c) for c in names if not isinstance(thin.schema[c.strip("`")].dataType, MapType)]
    return scratch.save(thin.orderBy(*order).withColumn("rid", F.monotonically_increasing_id()), "keyed"), False


def with_ids(out: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """out with doc_id in the place of rid; a join is needed only where they differ."""
    if same:
        return out.withColumn("doc_id", F.col("rid").cast(rows.schema["doc_id"].dataType)).drop("rid")
    return rows.select("rid", "doc_id").join(out, "rid").drop("rid")
