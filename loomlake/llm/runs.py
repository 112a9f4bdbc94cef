"""Periodic runs of words: Lyndon arrays of both alphabet orders in linear time, by extensions that reuse the furthest match so far."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import column, shingle_names
from .common import let, table, words

EXPONENT, LEAST = 4, 6
GRAM = 3
Run = tuple[int, int, int]  # start, length, period


def lyndon_edges(word: Sequence) -> tuple[list[int], list[int]]:
    """(after, match): for each place the next place whose suffix is smaller (the length if there is none), and how far both suffixes agree.

    The longest Lyndon word from i on ends before after[i]. Places are taken from left to right; those whose next smaller
    suffix is still open form a stack, linked through `lower`. Suffixes are compared by extending a match, in linear time
    overall and by nothing but comparisons of symbols, since a symbol is read again only where nothing known decides:

    * Below i on the stack stands `lower[i]`, which is smaller than i and agrees with it for `shared[i]` symbols. If that
      differs from the match of i and j, the lesser of both is its match with j, and how it compares is known as well; only
      where both are equal the match is extended.
    * The match that reached furthest says that the symbols from `right - shift` on are those from `right` on, up to
      `reach`. A pair inside it has a twin `shift` places before, compared already. Reading goes on where the twin's match
      ends or at `reach`, whichever comes first.
    """
    n = len(word)
    after, match = [n] * n, [0] * n
    lower, shared = [-1] * n, [0] * n
    right = shift = reach = 0
    for j in range(1, n):
        i, have = j - 1, 0
        while True:
            at = j + have
            if at < reach and i >= right:
                a, b = i - shift, j - shift
                known = match[a] if after[a] == b else shared[b] if lower[b] == a else have
                at = min(j + known, reach)
            back = at - j + i
            while at < n and word[back] == word[at]:
                at += 1
                back += 1
            if at >= reach:
                right, shift, reach = j, j - i, at
            have = at - j
            if at < n and word[back] < word[at]:
                break
            after[i], match[i] = j, have
            i, same = lower[i], shared[i]
            while i >= 0 and same > have:
                after[i], match[i] = j, have
                i, same = lower[i], shared[i]
            if i < 0 or same < have:
                have = same
                break
        lower[j], shared[j] = i, have
    return after, match


def runs_of(word: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[Run]:
    """Every run of a word whose length is at least `least` and `exponent` (2 or more) times its smallest period, by start, then period.

    In one of both orders of the alphabet, wherever a run's Lyndon root stands in it whole, the longest Lyndon word from
    there on is that root. So runs are read off the edges whose match behind the root is long enough: the leftmost edge of a
    run (of those with its period and its end) lies less than a period behind its start.
    """
    symbols, found = np.asarray(word, np.int64), []
    for order in (word, [-x for x in word]):
        after, match = (np.asarray(x, np.int64) for x in lyndon_edges(order))
        at = np.flatnonzero(match > (exponent - 2) * (after - np.arange(len(after))))
        period = after[at] - at
        _, leftmost = np.unique(np.stack([after[at] + match[at], period]), axis=1, return_index=True)
        for k in leftmost.tolist():
            start, p, end = int(at[k]), int(period[k]), int(after[at[k]] + match[at[k]])
            while start:
                low = max(0, start - p)
                off = np.flatnonzero(symbols[low:start] != symbols[low + p : start + p])
                start = low + int(off[-1]) + 1 if len(off) else low
                if len(off):
                    break
            if end - start >= max(least, exponent * p):
                found.append((start, end - start, p))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def stretches(names: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (begin, end) of words outside of which no run can stand.

    A run of EXPONENT periods q and LEAST words has EXPONENT * q - 2 or more windows of three words, those q apart equal, so
    each stands there three times. What lies between windows that a text has less often holds no run, and as a longer run of
    the same period would have such windows only, none goes on beyond its stretch.
    """
    if len(names) < LEAST:
        return []
    size = int(names.max()) + 1
    keys = (names[:-2] * size + names[1:-1]) * size + names[2:] if size < 1 << 21 else shingle_names(names, GRAM)
    ordered = np.sort(keys)
    often = ordered[2:][ordered[2:] == ordered[:-2]]
    if not len(often):
        return []
    good = np.zeros(len(keys) + 2, bool)
    good[1:-1] = np.isin(keys, often)
    edges = np.flatnonzero(good[1:] != good[:-1])
    return [(b, e + GRAM - 1) for b, e in zip(edges[::2].tolist(), edges[1::2].tolist()) if e - b + GRAM - 1 >= LEAST]


def text_runs(text: list[bytes]) -> list[Run]:
    """The runs of a text of words, on the alphabet of its words in byte order."""
    if len(text) < LEAST:
        return []
    rank = {w: k for k, w in enumerate(sorted(set(text)))}
    names = np.fromiter(map(rank.__getitem__, text), np.int64, len(text))
    return [(b + s, n, p) for b, e in stretches(names) for s, n, p in runs_of(names[b:e].tolist())]


def collapsed(text: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return text
    kept = np.ones(len(text), bool)
    for start, n, p in runs:
        kept[start + p : start + n] = False
    return [text[i] for i in np.flatnonzero(kept).tolist()]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        data, offsets = column(batch, "text")
        runs, rest = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[lo:hi].tobytes().split()  # bytes are split at space and 9 to 13
            runs.append(text_runs(text))
            rest.append(b" ".join(collapsed(text, runs[-1])))
        named = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), named, pa.array(rest, pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, by start, then period) and collapsed (the text without the repetitions) of every row of docs (doc_id, text).

    A run is a stretch of words with smallest period q and at least max(LEAST, EXPONENT * q) words that neither neighbour
    extends. `collapsed` leaves out each word that any run contains after its first q words; the others are joined by one
    space. One pass without a shuffle; a task holds a batch of rows, and a text's words. Null, empty and blank texts have no
    run and an empty `collapsed`. Repeated rows and ids keep a row each; an empty table gives an empty result; more columns,
    whatever they are called, are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_periods(doc_id: Column, text: Column) -> Column:
    """The text, made periodic from some word on in every tenth document by CRC-32 of its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(ws: Column) -> Column:
        n = F.size(ws)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda c: F.transform(ws, lambda w, i: F.when(i < c["a"], w).otherwise(F.get(ws, c["a"] + (i - c["a"]) % c["p"]))))
        return F.when(n > 0, F.array_join(again, " "))

    return F.when(h % 10 == 0, let(words(text), periodic)).otherwise(text)


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_periods(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("_b", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_b.start").alias("start"),
        (-F.col("_b.short")).alias("length"),
        F.col("_b.period").alias("period"),
        F.expr("1000 * -_b.short div _b.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
