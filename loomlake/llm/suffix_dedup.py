"""Suffix-array dedup: bytes under a window that also starts earlier in the corpus are removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table, with_ids
from .repeats import Kind, remove_windows, repeated_windows
from .suffixes import equal_runs

LENGTH = 100


def classes_by_suffix_array(text: list[int], starts: np.ndarray, length: int) -> np.ndarray:
    """Equal windows of a bin, by the suffix array that linear grouping builds."""
    return equal_runs(text, starts, length)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = 24, step: int = 16) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs: start, end) and kept (the bytes left) of every row of docs (doc_id, text).

    A byte goes where a string of `length` bytes that covers it also starts earlier: in a document with a smaller doc_id,
    or earlier in the same one. Strings are judged on the input. Matches never cross documents. Null and empty texts have
    no bytes; shorter texts stay whole. Repeated ids and rows are documents of their own, ordered by text. kept is binary,
    as a run may cut a character. An empty table gives an
    empty result; more columns of docs are ignored.
    """
    scratch, kind = Scratch(docs.sparkSession, "suffixes"), Kind("bytes", length, gram, step)
    rows, same = keyed(docs, scratch)
    hits = repeated_windows(rows.select("rid", "text"), kind, classes_by_suffix_array, True, scratch)
    out = remove_windows(rows.select("rid", "text"), hits, kind).withColumnRenamed("n_units", "n_bytes")
    return with_ids(out, rows, same)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
