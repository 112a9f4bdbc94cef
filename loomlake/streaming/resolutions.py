"""Alert resolutions that are written: a table in snapshots, moved on by one rename for each batch of a stream."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.reports import resolve_alerts

POINTER = "CURRENT"


class Snapshots:
    """A table in a folder: snapshots beside each other, and a small file that names the current one and the last batch it holds.

    A snapshot is written whole before the file is replaced, and the file is replaced by renaming another one over it. So a
    reader sees one snapshot or the next; what a broken batch has written is never named, and its batch is done again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark._jvm
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("x").toUri(), spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> dict | None:
        """name and batch of the current snapshot; None for a table that has none."""
        if not self.files.util().exists(self._at(POINTER)):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{POINTER}", wholetext=True).first()[0])

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self.spark.read.parquet(f"{self.path}/{now['name']}")

    def write(self, df: DataFrame) -> str:
        name = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def swap(self, name: str, batch: int) -> None:
        options = self.jvm.org.apache.hadoop.fs
        own = f"pointer-{uuid.uuid4().hex}"
        flags = self.jvm.java.util.EnumSet.of(options.CreateFlag.CREATE)
        made = self.spark.sparkContext._gateway.new_array(options.Options.CreateOpts, 1)
        made[0] = options.Options.CreateOpts.createParent()
        out = self.files.create(self._at(own), flags, made)
        out.write(json.dumps({"name": name, "batch": batch}).encode())
        out.close()
        over = self.spark.sparkContext._gateway.new_array(options.Options.Rename, 1)
        over[0] = options.Options.Rename.OVERWRITE
        self.files.rename(self._at(own), self._at(POINTER), over)


def resolve_into(table: Snapshots, resolutions: DataFrame, batch: int) -> bool:
    """Writes the table (alert_id, ..., resolved, notes, resolved_at) with a batch of resolutions (alert_id, notes, at); False where it holds the batch already.

    The latest resolution of an alert counts, also against one that the table has; resolutions without an alert are dropped.
    For foreachBatch: a batch that comes again, after a stop at any point, changes nothing.
    """
    now = table.current()
    if now is not None and now["batch"] >= batch:
        return False
    if now is None:
        raise ValueError("the table has no snapshot of alerts")
    alerts = table.read()
    held = alerts.where("resolved").selectExpr("alert_id", "notes", "resolved_at AS at")
    rest = [c for c in alerts.columns if c not in ("resolved", "notes", "resolved_at")]
    both = held.unionByName(resolutions.select("alert_id", "notes", "at"))
    last = both.groupBy("alert_id").agg({"at": "max"}).withColumnRenamed("max(at)", "resolved_at")
    done = resolve_alerts(alerts.select(*rest), both).join(last, "alert_id", "left")
    table.swap(table.write(done), batch)
    return True


def resolving(resolutions: DataFrame, path: str):
    """A stream writer that brings a stream of resolutions into the table of alerts at `path`; start() runs it."""

    def each(df: DataFrame, batch: int) -> None:
        resolve_into(Snapshots(df.sparkSession, path), df, batch)

    return resolutions.writeStream.foreachBatch(each)
