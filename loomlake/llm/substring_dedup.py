"""Substring dedup: words under a window that occurs more than once in the corpus are removed, found by suffix automata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed, table, with_ids
from .repeats import Kind, remove_windows, repeated_windows
from .suffixes import SuffixAutomaton

LENGTH = 35


def classes_by_automaton(text: list[int], starts: np.ndarray, length: int) -> np.ndarray:
    """Windows that the shard's automaton has seen in another string share class 0; every other window is a class of its own.

    The shard's strings build the automaton and are then streamed past it for matching statistics. Each string ends in a
    mark of its own, so no match runs from one string into the next.
    """
    marked, mark = [], -1
    for x in text:
        marked.append(x if x != 1 else mark)
        mark -= x == 1
    lengths, counts = SuffixAutomaton(marked).matching(marked, length)
    ends = np.asarray(starts) + length - 1
    repeated = (np.asarray(lengths)[ends] >= length) & (np.asarray(counts)[ends] > 1)
    return np.where(repeated, 0, np.arange(1, len(starts) + 1))


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = 10, step: int = 5) -> DataFrame:
    """doc_id, n_words, spans (removed word runs: start, end) and kept (the words left, joined by one space, UTF-8) of every row of docs (doc_id, text).

    A word goes where `length` consecutive words that cover it also start anywhere else, in the same document or another
    one; windows are judged on the input. Null, empty and blank texts have no words; shorter texts stay whole. Repeated
    ids and rows are documents of their own. An empty table gives an empty result; more columns of docs are ignored.

    The reference shards are the strings around shared anchors, dealt by core: an automaton of all references grows with
    the corpus and can't be broadcast, so each automaton stays in its task, and only the text that can match it is sent there.
    """
    scratch, kind = Scratch(docs.sparkSession, "substrings"), Kind("words", length, gram, step)
    rows, same = keyed(docs, scratch)
    hits = repeated_windows(rows.select("rid", "text"), kind, classes_by_automaton, False, scratch)
    out = remove_windows(rows.select("rid", "text"), hits, kind).withColumnRenamed("n_units", "n_words")
    return with_ids(out, rows, same)


def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
