"""Results that later steps or later queries read again, stored in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # temporary folder by application, on one machine only


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a session on one machine may leave it out, and then has one temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="loomlake-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(source: DataFrame, name: str, build: Callable[[str], None]) -> str:
    """The folder of what build(folder) writes from a source that is read from files; built once for each state of these files.

    The state is the name, length and time of every file in the folders of the source, of which the result's name holds a digest. A build goes to a folder
    of its own and is renamed when it is done, so neither a broken build nor two at a time leave half an index behind.
    """
    spark = source.sparkSession
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    state = []
    for parent in sorted({f.rsplit("/", 1)[0] for f in source.inputFiles()}):
        path = jvm.Path(spark._jvm.java.net.URI(parent))
        state += sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in path.getFileSystem(conf).listStatus(path) if s.isFile())
    at = f"{shared_folder(spark)}/{name}-{hashlib.sha256('\n'.join(state).encode()).hexdigest()[:32]}"
    target, own = jvm.Path(at), f"{at}.{uuid.uuid4().hex}"
    system = target.getFileSystem(conf)
    if not system.exists(target):
        build(own)
        if not system.rename(jvm.Path(own), target):
            if not system.exists(target):
                raise OSError(f"{own} could not be renamed to {at}")
            system.delete(jvm.Path(own), True)
    return at


def write_parts(df: DataFrame, path: str, by: str) -> None:
    """df in a folder for each value of a column; an empty df leaves its schema."""
    writer = df.write.mode("overwrite")
    (writer if df.isEmpty() else writer.partitionBy(by)).parquet(path)
