"""How far the sources of a language are from each other and from the whole, by the terms they use: an audit in exact integers.

The divergence of two sources is a sum over all terms of their language. By inclusion and exclusion over their supports it
is never taken term by term for every pair: histograms of counts price the terms that either side has, posting lists of the
terms that both have correct those, and the terms that neither has cost a constant each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import LOWER, column, pieces, word_names, word_spans
from .common import Scratch, table

LEAST_DOCS, TOP, ONE = 3, 200, 1_000_000_000
PIECE_BYTES = 1 << 24
PAIRS = 1 << 20  # pairs of a step
SALT = 16

#: Bytes of terms: letters, and all of characters beyond ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, its occurrences and its documents, each once for a piece of a batch."""
    for batch in batches:
        data, offsets = column(batch, "text")
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        wide = max(1, len(sources.dictionary))
        group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
        many = len(langs.dictionary) * wide
        for lo, hi in pieces(offsets, PIECE_BYTES):
            part = LOWER[data[offsets[lo] : offsets[hi]]]
            starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo], IS_TERM)
            if not len(starts):
                continue
            which, first = word_names(part, starts, ends)
            doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
            keys, n = np.unique(which * many + group[lo:hi][doc], return_counts=True)
            once = np.unique(doc * len(first) + which)
            docs = np.unique(once % len(first) * many + group[lo:hi][once // len(first)], return_counts=True)[1]
            raw = part.tobytes()
            terms = pa.array([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())], pa.string())
            of = keys % many
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of // wide)), sources.dictionary.take(pa.array(of % wide)), terms.take(pa.array(keys // many)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _corrections(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """lang, source, item, high, low: what the overlaps of rows (lang, source, p, p0) add to the one-sided prices; first: where the rows of a term begin.

    Each row meets those of its term, in steps of about PAIRS pairs. A step's sums are exact, as the low 32 bits and the
    rest are added apart.
    """
    langs, sources = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    own, zero = (rows.column(c).to_numpy() for c in ("p", "p0"))
    wide = len(sources.dictionary)
    labels, who = np.unique(langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy(), return_inverse=True)
    begin, term = np.flatnonzero(first), np.cumsum(first) - 1
    reps, start = np.diff(np.append(begin, len(first)))[term], begin[term]
    upto, lo = np.concatenate([[0], np.cumsum(reps)]), 0
    while lo < len(reps):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), reps[lo:hi])
        b = np.arange(len(a)) - np.repeat(upto[lo:hi] - upto[lo] - start[lo:hi], reps[lo:hi])
        a, b = a[a != b], b[a != b]
        more = _f(own[a], own[b]) - _f(own[a], zero[b]) - _f(zero[a], own[b]) + _f(zero[a], zero[b])
        pair, at = np.unique(who[a] * len(labels) + who[b], return_inverse=True)
        low, high = (np.bincount(at, x.astype(float), len(pair)).astype(np.int64) for x in (more & 0xFFFFFFFF, more >> 32))
        ours, other = labels[pair // len(labels)], labels[pair % len(labels)]
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(ours // wide)), sources.dictionary.take(pa.array(ours % wide)), sources.dictionary.take(pa.array(other % wide)), pa.array(high), pa.array(low)], ["lang", "source", "item", "high", "low"])
        lo = hi


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of a partition (lang, term, source, p, p0) that is sorted by language and term; the last term of a batch waits for the next one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([rest, batch]) if rest is not None else batch
        ids = [rows.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
        first = np.concatenate([[True], (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])])
        cut = int(np.flatnonzero(first)[-1])
        if cut:
            yield from _corrections(rows.slice(0, cut), first[:cut])
        rest = rows.slice(cut)
    if rest is not None:
        yield from _corrections(rest, np.arange(rest.num_rows) == 0)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + 1) / (total + terms)) in exact integers; null where there are no terms."""
    over = F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return 1 + F.call_function("div", F.lit(ONE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), over)


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _times(k: Column, value: Column) -> Column:
    return (k.cast("decimal(19,0)") * value.cast("decimal(19,0)")).cast("decimal(38,0)")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text): part `pair` compares a source with each other source of its language, part `term` lists the terms it uses more than its language does.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those in at least `least`
    of its rows. With V kept terms, of which a group or language has N occurrences, p = 1 + floor(10^9 (n + 1) / (N + V))
    for a term it has n times, and the value against q is floor((p - q)^2 / q): in `pair` summed over all kept terms (0 if
    there are none), q the other source's; in `term` of one term with n > 0 and p > q, q the language's, the best `top`.
    Ranks go by value, then by item.

    Null languages, sources and texts are ''; a group without a term is there with p of n = 0. Each row is a document,
    repeated rows too; an empty table gives an empty result; other columns are ignored. Terms are dealt by language and
    term, so no source gathers in a task; a term's rows are at most the sources of its language, of which the result holds
    all pairs.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    each = Window.partitionBy("lang", "term")
    marked = summed.select("lang", "term", "source", "n", F.sum("n").over(each).alias("all_n"), F.sum("docs").over(each).alias("df"), (F.min("source").over(each) == F.col("source")).alias("first"))
    kept = scratch.save(marked.where(F.col("df") >= least).drop("df"), "kept")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.count_if("first").alias("terms"))
    known = texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill(0)
    whole = Window.partitionBy("lang")
    groups = known.select("lang", "source", "total", "support", F.sum("terms").over(whole).alias("terms"), F.sum("total").over(whole).alias("all_total"))
    groups = scratch.save(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    priced = kept.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", _share(F.col("all_n"), F.col("all_total"), F.col("terms")))

    terms = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), _value(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(terms).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    other = groups.select("lang", F.col("source").alias("item"), F.col("support").alias("item_support"), F.col("p0").alias("item_p0"))
    apart = F.col("source") != F.col("item")
    neither = groups.join(other, "lang").where(apart).select("lang", "source", "item", F.coalesce(_times(F.col("terms") - F.col("support") - F.col("item_support"), _value(F.col("p0"), F.col("item_p0"))), F.lit(0).cast("decimal(38,0)")).alias("part"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).withColumn("_salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALT)))
    dealt = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    both = F.array(
        F.struct(F.col("source").alias("source"), F.col("item").alias("item"), _times(F.col("k"), _value(F.col("p"), F.col("item_p0"))).alias("part")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), _times(F.col("k"), _value(F.col("item_p0"), F.col("p"))).alias("part")),
    )
    sides = histogram.join(dealt, ["lang", "_salt"]).where(apart).select("lang", F.inline(both))
    ordered = priced.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    corrected = ordered.mapInArrow(_overlaps, "lang string, source string, item string, high long, low long")
    overlaps = corrected.select("lang", "source", "item", (F.col("high").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low").cast("decimal(19,0)")).cast("decimal(38,0)").alias("part"))
    values = neither.unionByName(sides).unionByName(overlaps).groupBy("lang", "source", "item").agg(F.sum("part").cast("long").alias("value"))
    pairs = ranked(values).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS all_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total FROM d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
v AS (SELECT lang, count(*) AS terms, sum(all_n) AS all_total FROM k GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1)::HUGEINT // (total + terms)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (all_n + 1)::HUGEINT // (all_total + terms)::HUGEINT AS q
    FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200"""
