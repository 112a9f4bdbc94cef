"""A stored vector index: product-quantised residuals in lists around fitted centres, scored in groups of queries, then confirmed by exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored

CODES = 256  # codes of a part: one byte
WIDTH = 4  # numbers of a part
BLOCK = 4096  # codes of a row
GROUP = 64  # queries of a product of matrices
ASKED = 256  # queries that pass the index together
SHARDS = 4  # parts of the index, each of which gives a shortlist of every query
DEALT = 1_000_000  # rows of a file of the index
PIECE = 1024  # rows compared with all centres at once
SAMPLE, ROUNDS = 20_000, 12


def _units(array: pa.Array) -> np.ndarray:
    """Rows of vectors of one length, each of length 1; a vector of zeros stays."""
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(array), -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; products are held for a piece of the rows only."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([(rows[at : at + PIECE] @ centres.T - half).argmax(1) for at in range(0, len(rows), PIECE)])


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of rows; one that is left without rows begins again at a row."""
    centres = rows[rng.choice(len(rows), k, replace=len(rows) < k)]
    for _ in range(ROUNDS):
        near = _nearest(rows, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, rows)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rows[rng.integers(len(rows), size=k)])
    return centres


def _together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """keys, flat: up to `most` rows in one, their vectors of length 1 one after another."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            rows = _units(part.column(1))
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for n, x in ((part.num_rows, part.column(0)), (rows.size, pa.array(rows.ravel())))]
            yield pa.RecordBatch.from_arrays(lists, ["keys", "flat"])


def _products(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """query, key, similarity of a block of rows and one of queries, by one product of matrices: the k best of each query, with all that equal the last of them."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys, flat, queries, asked = (batch.column(c).slice(i, 1).flatten() for c in range(4))
            rows, qs = (x.to_numpy().reshape(len(n), -1) for x, n in ((flat, keys), (asked, queries)))
            near = np.round(qs @ rows.T, 12)
            least = -np.partition(-near, min(k, len(keys) - 1), axis=1)[:, min(k, len(keys) - 1)]  # one more than k, as a query may meet itself
            q, r = np.nonzero(near >= least[:, None])
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), keys.take(pa.array(r)), pa.array(near[q, r])], ["query", "key", "similarity"])


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = GROUP, key: str = "vec_id") -> DataFrame:
    """query, key, similarity: the k most similar rows to each of a stated set of queries (key, embedding), the query itself left out.

    Rows and queries are put together in blocks where they lie. Whether the queries' blocks are broadcast is left to Spark's
    size check; beyond it partitions of rows meet partitions of queries. A pair of blocks is one matrix product, of which
    only each query's best rows leave. Null and empty embeddings are left out; a vector of zeros is at 0 to all.
    """
    kind = vectors.schema[key].dataType.simpleString()
    some = lambda df: df.where("embedding is not null and size(embedding) > 0").select(key, "embedding")
    blocks = lambda df, most: some(df).mapInArrow(partial(_together, most=most), f"keys array<{kind}>, flat array<double>")
    met = blocks(vectors, BLOCK).join(blocks(queries, block).toDF("queries", "asked"))
    best = met.mapInArrow(partial(_products, k=k), f"query {kind}, key {kind}, similarity double").where("query != key").withColumnRenamed("key", key)
    ranked = best.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key)))
    return ranked.where(F.col("_k") <= k).select("query", key, "similarity")


def _codes(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """key, list, code of each row: its nearest centre, and the nearest code of each part of what is left."""
    centres, books = model.value
    for batch in batches:
        if batch.num_rows:
            rows = _units(batch.column(1))
            near = _nearest(rows, centres)
            parts = np.pad(rows - centres[near], ((0, 0), (0, books.shape[0] * WIDTH - rows.shape[1]))).reshape(len(rows), -1, WIDTH)
            code = np.stack([_nearest(parts[:, m], book) for m, book in enumerate(books)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["key", "list", "code"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """list, keys, codes: rows sorted by list, up to BLOCK of a list in one."""
    for batch in batches:
        lists = batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(lists)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(lists)]):
            for at in range(lo, hi, BLOCK):
                part = batch.slice(at, min(BLOCK, hi - at))
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1).slice(0, 1), keys, pa.array([b"".join(part.column(2).to_pylist())], pa.binary())], ["list", "keys", "codes"])


def build(vectors: DataFrame, path: str, key: str = "vec_id", lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Writes the index of vectors (key, embedding; all of one length, null ones left out) to a folder: `codes`, `centres` and `books`.

    Lists number as the root of the rows (or `lists`), and an eighth of the sample at most. Centres and codebooks are
    fitted on the driver on at most `sample` rows, taken by hash of the key; every row is coded. Rows are dealt by ranges of
    list and a hash of the key, so that a small list lies in one block as a rule and a large one in many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding is not null and size(embedding) > 0").select(F.col(key).alias("key"), "embedding")
    kind = rows.schema["key"].dataType.simpleString()
    n = rows.count()
    few = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(sample).select("embedding").toArrow().column(0)
    rng = np.random.default_rng(seed)
    units = _units(few.combine_chunks()) if n else np.zeros((1, 1))
    centres = _kmeans(units, max(1, min(lists or round(n**0.5), len(units) // 8 or 1)), rng)
    left = units - centres[_nearest(units, centres)]
    parts = -(-units.shape[1] // WIDTH)
    left = np.pad(left, ((0, 0), (0, parts * WIDTH - units.shape[1]))).reshape(len(units), parts, WIDTH)
    books = np.stack([_kmeans(left[:, m], CODES, rng) for m in range(parts)])
    model = spark.sparkContext.broadcast((centres, books))
    coded = stored(rows.mapInArrow(partial(_codes, model=model), f"key {kind}, list int, code binary"), "coded")
    dealt = coded.repartitionByRange(max(SHARDS, n // DEALT), "list", F.xxhash64("key")).sortWithinPartitions("list", "key")
    dealt.mapInArrow(_packed, f"list int, keys array<{kind}>, codes binary").write.mode("overwrite").parquet(f"{path}/codes")
    for name, array in (("centres", centres), ("books", books.reshape(-1, CODES * WIDTH))):
        spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(array)], "i int, v array<double>").write.mode("overwrite").parquet(f"{path}/{name}")


def _fitted(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres and codebooks, of which there are at most an eighth of the fit's sample, and one for each part."""
    centres, books = (np.array([r.v for r in spark.read.parquet(f"{path}/{t}").orderBy("i").collect()]) for t in ("centres", "books"))
    return centres, books.reshape(-1, CODES, WIDTH)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, q: vectors of length 1."""
    for batch in batches:
        if batch.num_rows:
            rows = _units(batch.column(1))
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), q], ["query", "q"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """queries, flat: up to ASKED queries in one, their vectors as bytes one after another."""
    for batch in batches:
        for at in range(0, batch.num_rows, ASKED):
            part = batch.slice(at, ASKED)
            flat = part.column(1).flatten().to_numpy(zero_copy_only=False).tobytes()
            queries = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            yield pa.RecordBatch.from_arrays([queries, pa.array([flat], pa.binary())], ["queries", "flat"])


class _Shortlists:
    """The `most` rows with the largest estimates of each query of a group, ties by key, over any number of blocks of codes.

    Of a block only those rows are taken up that reach a query's last one so far, so what is held stays at a few shortlists
    and one block, however many blocks there are.
    """

    def __init__(self, queries: pa.Array, flat: bytes, centres: np.ndarray, books: np.ndarray, share: float, most: int):
        self.queries, self.centres, self.books, self.most = queries, centres, books, most
        self.qs = np.frombuffer(flat, np.float64).reshape(len(queries), -1)
        near = np.argsort(-(self.qs @ centres.T), axis=1, kind="stable")[:, : max(1, round(share * len(centres)))]
        self.reads = np.zeros((len(queries), len(centres)), bool)
        np.put_along_axis(self.reads, near, True, axis=1)
        self.least = np.full(len(queries), -np.inf)
        self.held: list[tuple[pa.Array, ...]] = []
        self.n = 0

    def add(self, at: int, keys: pa.Array, codes: bytes) -> None:
        """A block of the list numbered `at`, for the queries that read this list."""
        asked = np.flatnonzero(self.reads[:, at])
        if not len(asked):
            return
        code = np.frombuffer(codes, np.uint8).reshape(len(keys), -1)
        rows = self.books[np.arange(len(self.books)), code].reshape(len(keys), -1)[:, : self.qs.shape[1]] + self.centres[at]
        about = self.qs[asked] @ rows.T
        q, r = np.nonzero(~(about < self.least[asked, None] - 1e-11))  # a query that isn't a number keeps rows, too
        self.held.append((pa.array(asked[q]), keys.take(pa.array(r)), pa.array(np.round(about[q, r], 12))))
        self.n += len(q)
        if self.n > 4 * self.most * len(self.qs):
            self.cut()

    def cut(self) -> None:
        q, key, about = (pa.concat_arrays(x) for x in zip(*self.held))
        order = pc.sort_indices(pa.table([q, about, key], ["q", "about", "key"]), sort_keys=[("q", "ascending"), ("about", "descending"), ("key", "ascending")])
        which = q.take(order).to_numpy()
        place = np.arange(len(which)) - np.searchsorted(which, which)
        kept = order.take(pa.array(np.flatnonzero(place < self.most)))
        last = place == self.most - 1
        self.least[which[last]] = about.take(order).to_numpy()[last]
        self.held, self.n = [(q.take(kept), key.take(kept), about.take(kept))], len(kept)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            q, key, about = self.held[0]
            yield pa.RecordBatch.from_arrays([self.queries.take(q), key, about], ["query", "key", "about"])


def _shortlisted(batches: Iterator[pa.RecordBatch], model, share: float, most: int) -> Iterator[pa.RecordBatch]:
    """query, key, about: the shortlist of each query over the blocks that its group meets one after another."""
    group, now = None, None
    for batch in batches:
        for i, this in enumerate(batch.column(0).to_pylist()):
            if this != group:
                if now:
                    yield from now.rows()
                group, now = this, _Shortlists(batch.column(1).slice(i, 1).flatten(), batch.column(2)[i].as_py(), *model.value, share, most)
            now.add(batch.column(3)[i].as_py(), batch.column(4).slice(i, 1).flatten(), batch.column(5)[i].as_py())
    if now:
        yield from now.rows()


def search(vectors: DataFrame, path: str, queries: DataFrame, k: int, share: float, shortlist: int, key: str = "vec_id") -> DataFrame:
    """query, key, similarity: about the k most similar rows to each query (key, embedding), the query itself and vectors of zeros left out.

    The share of the lists nearest to a query is read, a byte for every WIDTH numbers of a row; of their rows the
    `shortlist` with the largest estimates are compared by their own vectors. Groups of ASKED queries meet each of SHARDS
    parts of the index, a group at a time, and only their shortlists of that part leave the task: as many rows a query
    however many rows the index has, and no more than a group's shortlists held in a task.
    """
    spark = vectors.sparkSession
    model = spark.sparkContext.broadcast(_fitted(spark, path))
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.where("embedding is not null and size(embedding) > 0").select(F.col(key).alias("query"), "embedding").repartition("query")
    own = stored(asked.mapInArrow(_unit_rows, f"query {kind}, q array<double>"), "asked")
    groups = own.mapInArrow(_groups, f"queries array<{kind}>, flat binary").select(F.monotonically_increasing_id().alias("group"), "queries", "flat")
    blocks = spark.read.parquet(f"{path}/codes").select("list", "keys", "codes").coalesce(SHARDS)
    met = groups.hint("shuffle_replicate_nl").crossJoin(blocks)  # each task goes through its part of the index once a group
    about = met.mapInArrow(partial(_shortlisted, model=model, share=share, most=shortlist + 1), f"query {kind}, key {kind}, about double").where("query != key")
    few = about.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("about"), "key"))).where(F.col("_k") <= shortlist).select("query", "key")
    rows = vectors.where("embedding is not null").select(F.col(key).alias("key"), "embedding")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    named = rows.join(few, "key").join(own, "query").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    exact = named.select("query", F.col("key").alias(key), (dot("v", "q") / F.nullif(F.sqrt(dot("v", "v")), F.lit(0.0))).alias("similarity")).where("similarity is not null")
    ranked = exact.withColumn("_k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key)))
    return ranked.where(F.col("_k") <= k).select("query", key, "similarity")
