"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole sets, and grouping of the links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, column, hash_bytes, hash_symbols, mix, pieces, shingle_names, word_names, word_spans
from .common import Scratch, keyed, secret, spread_join, table

BANDS, ROWS = 42, 6
SLOTS = BANDS * ROWS
CHUNK = 2048  # members of a bucket that are held against each other at once
MARGIN = 0.14  # a pair whose signatures agree less than the threshold less this (over five deviations) is no candidate
PART = 1 << 15  # shingles that are signed together
_GOLD = 0x9E3779B97F4A7C15


def shingle_places(size: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word behind the last) of every shingle of texts with so many words: n words, or all words of a shorter text."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    many = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), many)
    first = bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, first, np.minimum(first + n, bounds[text + 1])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, fixed hash, keyed hash) of every distinct shingle of consecutive texts, in that order; words are lower-cased."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    text, first, end = shingle_places(np.diff(bounds), n)
    pair = [hash_symbols(hash_bytes(low, starts, ends, seed), first, end, seed) for seed in (1, key)]
    order = np.lexsort((pair[1], pair[0], text))
    text, a, b = text[order], pair[0][order], pair[1][order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return text[new], a[new], b[new]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, name) of every distinct shingle, in that order. Within a call, names are equal where the words are, byte for byte."""
    low = LOWER[data]
    starts, ends, bounds = word_spans(low, offsets)
    names, _ = word_names(low, starts, ends)
    size = np.diff(bounds)
    padded = np.zeros(len(names) + (n - 1) * len(size), np.int64)  # n - 1 empty words end each text, so short texts have a shingle too
    padded[np.arange(len(names)) + np.repeat(np.arange(len(size)) * (n - 1), size)] = names + 1
    text, first, _ = shingle_places(size, n)
    shingle = shingle_names(padded, n)[first + text * (n - 1)] if len(first) else first
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return text[new], shingle[new]


def super_minhash(text: np.ndarray, elements: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets of elements; text rises.

    Every element deals the slots out in an order of its own, and at its j-th slot bids j plus a fraction; the least bid
    holds the slot. PART elements take a step together. A text stops once each of its slots is held by a bid below the next
    step's, as later bids are higher; so long texts need a few steps, and only sets smaller than the signature need more.
    Orders are kept for the elements at hand only. Empty sets keep infinity.
    """
    held = np.full((texts, slots), np.inf)
    for at in range(0, len(elements), PART):
        own, e = text[at : at + PART], elements[at : at + PART]
        deals = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(e), 1))
        on = np.arange(len(e))
        t0, t1 = own[0], own[-1] + 1
        for j in range(slots):
            draw = mix(e[on] + np.uint64((j + 1) * _GOLD % 2**64))
            k = j + (mix(draw ^ np.uint64(_GOLD)) % np.uint64(slots - j)).astype(np.int64)
            slot = deals[on, k]
            deals[on, k] = deals[on, j]
            np.minimum.at(held, (own[on], slot), j + (draw >> np.uint64(11)) * 2.0**-53)
            open_ = held[t0:t1].max(axis=1) >= j + 1
            on = on[open_[own[on] - t0]]
            if not len(on):
                break
    return held


def _digest(*parts: np.ndarray) -> bytes:
    return hashlib.blake2b(b"".join(x.tobytes() for x in parts), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], words: int, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = column(batch, "text")
        for lo, hi in pieces(offsets):
            text, elements, keyed_ = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], words, key)
            n = np.bincount(text, minlength=hi - lo)
            held = super_minhash(text, elements, hi - lo).view(np.uint64)
            at = np.concatenate([[0], np.cumsum(n)]).tolist()
            content = [_digest(elements[x:y], keyed_[x:y]) for x, y in zip(at, at[1:])]
            sig = np.ascontiguousarray((mix(held) & np.uint64(255)).astype(np.uint8))
            byte = np.uint64(256) ** np.arange(ROWS, dtype=np.uint64)
            keys = (sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * byte).sum(axis=2, dtype=np.uint64)
            keys = mix(keys + (np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)))
            list_at = pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32))
            sig_at = np.arange(0, (hi - lo + 1) * SLOTS, SLOTS, dtype=np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "rid": rids[lo:hi], "n_shingles": n.astype(np.int64), "content": pa.array(content, pa.binary()),
                    "keys": pa.ListArray.from_arrays(list_at, pa.array(keys.ravel().view(np.int64))),
                    "sig": pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(sig_at), pa.py_buffer(sig)]),
                }
            )


def _agreeing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, at_a), (b, at_b) = column(batch, "sig_a"), column(batch, "sig_b")
        n = batch.num_rows
        same = (a[at_a[0] : at_a[-1]].reshape(n, SLOTS) == b[at_b[0] : at_b[-1]].reshape(n, SLOTS)).sum(axis=1) if n else np.zeros(0, int)
        yield batch.select(["a", "b"]).filter(pa.array(same >= least))


def _confirmed(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (a, at_a), (b, at_b) = column(batch, "text_a"), column(batch, "text_b")
        for lo, hi in pieces(at_a + at_b):
            data, offsets = np.concatenate([a[at_a[lo] : at_a[hi]], b[at_b[lo] : at_b[hi]]]), np.concatenate([at_a[lo:hi] - at_a[lo], at_b[lo : hi + 1] - at_b[lo] + at_a[hi] - at_a[lo]])
            text, shingle = shingle_sets(data, offsets, words)
            sizes = np.bincount(text % (hi - lo), minlength=hi - lo)
            order = np.lexsort((shingle, text % (hi - lo)))
            text, shingle = text[order] % (hi - lo), shingle[order]
            both = np.bincount(text[1:][(text[1:] == text[:-1]) & (shingle[1:] == shingle[:-1])], minlength=hi - lo)
            yield batch.select(["a", "b"]).slice(lo, hi - lo).filter(pa.array(100 * both >= percent * (sizes - both)))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (key, i, j) after another; they come sorted so."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table_ = pa.Table.from_batches(held).combine_chunks()
        key, i, j = (table_.column(c).to_numpy() for c in ("key", "i", "j"))
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()]
        for e0, e1 in zip(edges, edges[1:]):
            yield table_.slice(e0, e1 - e0)
        held = table_.slice(edges[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(group: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row of the group and the later rows that it is to be compared with: of the other chunk or, where the chunks are one,
    of its own; of another component; with signatures that agree enough; and this band is the first that the two share, so
    a pair comes once, in one bucket."""
    side, comp = (group.column(c).to_numpy() for c in ("side", "comp"))
    i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(group.num_rows, SLOTS)
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for n, x in enumerate(left):
        others = right[n + 1 :] if i == j else right
        others = others[comp[others] != comp[x]]
        if len(others):
            same = sig[others] == sig[x]
            hit = same.sum(axis=1) >= least
            if hit.any():
                first = same[hit].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                others = others[hit][first == band]
                if len(others):
                    yield int(x), others


def _hopeful(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket that have a candidate in it."""
    for group in _groups(batches):
        wanted = np.zeros(group.num_rows, bool)
        for x, others in _candidates(group, least):
            wanted[x] = True
            wanted[others] = True
        if wanted.any():
            yield from group.filter(pa.array(wanted)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch], words: int, percent: int, least: int) -> Iterator[pa.RecordBatch]:
    """Links between components within each bucket, confirmed on whole sets. What a bucket's earlier links join isn't compared again."""
    for group in _groups(batches):
        data, offsets = column(group.to_batches()[0], "text")
        text, shingle = shingle_sets(data[offsets[0] : offsets[-1]], offsets - offsets[0], words)
        at = np.searchsorted(text, np.arange(group.num_rows + 1))
        size, rid, comp, found = np.diff(at), group.column("rid").to_numpy(), group.column("comp").to_numpy().copy(), []
        for x, others in _candidates(group, least):
            others = others[comp[others] != comp[x]]
            if not len(others):
                continue
            own = shingle[at[x] : at[x + 1]]
            rows = np.repeat(np.arange(len(others)), size[others])
            theirs = shingle[np.arange(len(rows)) + np.repeat(at[others] - (np.cumsum(size[others]) - size[others]), size[others])]
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.bincount(rows[hit], minlength=len(others))
            for y in others[100 * both >= percent * (size[x] + size[others] - both)]:
                if comp[y] != comp[x]:
                    found.append((min(rid[x], rid[y]), max(rid[x], rid[y])))
                    comp[comp == comp[y]] = comp[x]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """rid, comp: every linked row with the smallest rid it reaches. links: a, b.

    Union-find as joins: in turn, each row hands the least of its neighbours to its larger and to its smaller neighbours,
    until the links are stars around their least row. Links stay in tables; the driver sees a count and a sum for each turn.
    """
    edges = scratch.save(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    seen, turn = None, 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.save(small, f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("rid"), F.col("v").alias("comp"))
        seen = now


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, rid, n_shingles, component_rid, component_id and kept of every row of docs (doc_id, text).

    A document's set holds its distinct shingles of `words` words, A-Z lower-cased; fewer words are one shingle, none are an
    empty set, which links with nothing. Documents are linked where 100 * intersection >= percent * union, confirmed on
    whole sets; component_id is the smallest doc_id that links reach, and kept says that it is the row itself. Null texts
    are empty. Repeated rows and ids are rows of their own. An empty table gives an empty result; more columns are ignored.

    Equal sets are one class, which one row stands for. Each bucket of a band first tries its members against its least
    row, which joins most copies. Only buckets that still hold several components are then looked at across components, a
    pair of chunks in a task; what agrees enough by signature is confirmed there on whole sets, so that links leave the
    task but pairs don't. At 80 % a pair shares no band with a probability of 3 in a million; a lower `percent` is refused.
    Links are confirmed on the words themselves; equal sets are those whose sorted 128-bit shingle hashes, half of them
    keyed anew for each call, have one 128-bit digest.
    """
    if percent < 80:
        raise ValueError("the bands are made for 80 per cent and more")
    scratch = Scratch(docs.sparkSession, "minhash")
    rows, same = keyed(docs, scratch)
    signed = scratch.save(rows.select("rid", "text").mapInArrow(partial(_signed, words=words, key=secret()), "rid long, n_shingles long, content binary, keys array<long>, sig binary"), "signed")
    classes = scratch.save(signed.where("n_shingles > 0").groupBy("content").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = scratch.save(classes.select(F.col("rep").alias("rid")).join(signed.select("rid", "keys", "sig"), "rid"), "reps")
    bands = reps.select("rid", F.posexplode("keys").alias("band", "key"))
    buckets = scratch.save(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("hub")).where("n > 1"), "buckets")
    members = scratch.save(bands.join(buckets, "key"), "members")
    least = round((percent / 100 - MARGIN) * SLOTS)
    sig = reps.select("rid", "sig")

    texts = rows.select("rid", "text")
    stars = scratch.save(members.where("rid != hub").select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct(), "stars")
    signs = stars.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    likely = scratch.save(signs.mapInArrow(partial(_agreeing, least=least), "a long, b long"), "likely")
    both = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    links = scratch.save(both.mapInArrow(partial(_confirmed, words=words, percent=percent), "a long, b long"), "links")
    comps = components(links, scratch)
    labelled = scratch.save(members.where("n > 2").drop("hub").join(comps, "rid", "left").withColumn("comp", F.coalesce("comp", "rid")), "labelled")
    several = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 != c1").select("key")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    side = F.pmod(F.xxhash64("rid"), chunks).cast("int")
    spread = labelled.join(several, "key", "left_semi").join(sig, "rid").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = spread.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "band", "rid", "comp", "sig")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    hopeful = scratch.save(by_bucket(dealt).mapInArrow(partial(_hopeful, least=least), dealt.schema), "hopeful")
    held = by_bucket(hopeful.join(texts, "rid")).mapInArrow(partial(_linked, words=words, percent=percent, least=least), "a long, b long")
    more = scratch.save(held.distinct(), "more")
    scratch.drop("members", "labelled", "buckets", "stars", "likely", "hopeful", "reps")
    if not more.isEmpty():
        comps = components(links.unionByName(more), Scratch(docs.sparkSession, "minhash"))
    scratch.drop("links", "more")
    named = classes.join(comps.toDF("rep", "comp"), "rep", "left").select("content", "copies", F.coalesce("comp", "rep").alias("component_rid"))
    some, none = signed.where("n_shingles > 0"), signed.where("n_shingles = 0").select("rid", "n_shingles", F.col("rid").alias("component_rid"))
    if same:
        out = spread_join(some.select("rid", "n_shingles", "content"), named, ["content"], some.count()).select("rid", "n_shingles", "component_rid").unionByName(none)
        kind = rows.schema["doc_id"].dataType
        out = out.withColumn("doc_id", F.col("rid").cast(kind)).withColumn("component_id", F.col("component_rid").cast(kind))
    else:
        ids = rows.select("rid", "doc_id")
        named = named.join(ids.toDF("component_rid", "component_id"), "component_rid")
        out = spread_join(some.select("rid", "n_shingles", "content"), named, ["content"], some.count()).select("rid", "n_shingles", "component_rid", "component_id")
        out = out.unionByName(none.join(ids.toDF("rid", "component_id"), "rid")).join(ids, "rid")
    return out.withColumn("kept", F.col("rid") == F.col("component_rid"))


def op3_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=4).select("doc_id", "n_shingles", "component_id", "kept")
