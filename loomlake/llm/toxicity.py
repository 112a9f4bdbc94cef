"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrays import LOWER, column, hash_bytes, pieces
from .common import table, without

BITS = 18
PREFIXES = (4, 5)  # bytes; stems are features beside whole tokens
SAMPLE = 2000  # labelled rows of each kind (clean, toxic) that the model is fitted on at most
GRADES = 3  # of toxic rows
REJECT = 0.5  # expected severity from which a document is rejected
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of every token's features, and tokens by text. Tokens are lower-cased runs of letters, digits and bytes above 127."""
    low = LOWER[data]
    inside = _TOKEN[low]
    before = np.concatenate([[False], inside])
    before[offsets[offsets <= len(low)]] = False
    after = np.concatenate([inside, [False]])
    after[offsets] = False
    starts, ends = np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    mask = np.uint64((1 << BITS) - 1)
    kinds = [(hash_bytes(low, starts, ends, 1) & mask).astype(np.int64)]
    texts = [text]
    for k, n in enumerate(PREFIXES, 1):
        long = ends - starts >= n
        kinds.append((hash_bytes(low, starts[long], starts[long] + n, 1) & mask).astype(np.int64) + (k << BITS))
        texts.append(text[long])
    return np.concatenate(texts), np.concatenate(kinds), np.bincount(text, minlength=len(offsets) - 1)


@dataclass
class Ordinal:
    """P(severity > k) = 1 / (1 + exp(thresholds[k] - score)); one weight vector for all thresholds, which rise."""

    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.above(score).sum(axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, steps: int = 80, rate: float = 0.1, decay: float = 1e-3) -> Ordinal:
    """Maximum likelihood by Adam over the sparse matrix (rows sorted, columns, values) and the grades 0, 1, ..."""
    k = max(int(grades.max()), 1)
    used, where = np.unique(columns, return_inverse=True)
    w, gaps = np.zeros(len(used)), np.concatenate([[1.0], np.full(k - 1, 0.0)])  # first threshold, logs of the steps up
    at = np.searchsorted(rows, np.arange(len(grades) + 1))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]

    def scores() -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[where] * values)])
        return sums[at[1:]] - sums[at[:-1]]

    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        above = Ordinal(w, thresholds).above(scores())
        padded = np.concatenate([np.ones((len(grades), 1)), above, np.zeros((len(grades), 1))], axis=1)
        i = np.arange(len(grades))
        a, b = padded[i, grades], padded[i, grades + 1]
        p = np.maximum(a - b, 1e-9)
        to_score = (1 - a - b) / len(grades)  # gradient of the log-likelihood
        to_threshold = np.zeros(k + 2)
        np.add.at(to_threshold, grades, -a * (1 - a) / p / len(grades))
        np.add.at(to_threshold, grades + 1, b * (1 - b) / p / len(grades))
        g_threshold = to_threshold[1 : k + 1]
        suffix = np.cumsum(g_threshold[::-1])[::-1]
        grads = np.bincount(where, to_score[rows] * values, len(used)) - decay * w, np.concatenate([suffix[:1], suffix[1:] * np.exp(gaps[1:])])
        for param, grad, m, v in ((w, grads[0], state[0], state[1]), (gaps, grads[1], state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Ordinal(weights, np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])])))


def log_odds(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, size: int, least: float = 2.0) -> np.ndarray:
    """For each feature how much more likely toxic rows have it, as a logarithm; 0 where that is less than `least` standard errors.

    Features are scaled by it before the fit, so that the decay of weights bears on features that tell nothing.
    """
    with_, n = np.bincount(columns, toxic[rows], size), toxic.sum()
    without, m = np.bincount(columns, minlength=size) - with_, len(toxic) - n
    odds = np.log((with_ + 0.5) / (n - with_ + 0.5)) - np.log((without + 0.5) / (m - without + 0.5))
    error = np.sqrt(1 / (with_ + 0.5) + 1 / (n - with_ + 0.5) + 1 / (without + 0.5) + 1 / (m - without + 0.5))
    return np.where(np.abs(odds) >= least * error, odds, 0.0)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grade, columns, values of each row: a feature's value is its share of the tokens in per cent."""
    for batch in batches:
        data, offsets = column(batch, "text")
        for lo, hi in pieces(offsets):
            text, feature, tokens = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            pairs, n = np.unique((text << 24) | feature, return_counts=True)
            text = pairs >> 24
            at = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
            values = (100 * n / np.maximum(tokens[text], 1)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(at, pa.array((pairs & 0xFFFFFF).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values))], ["grade", "columns", "values"]
            )


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grades: int = GRADES) -> Ordinal | None:
    """The model from docs (doc_id, text) and labels (doc_id, toxic); None where either kind of label is missing or no feature tells them apart.

    `sample` bounds the rows of each kind, taken by hash of doc_id, and of rows
    that share an id the one with the least text is taken, so the driver holds 2 * sample sparse rows at most.
    Labels say toxic or not; a first fit of that orders the toxic rows, and equal parts of that order are severity 1 to
    `grades`. The second fit is the ordinal one. Null labels are left out.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("grade")).distinct()
    chosen = known.where("grade = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionByName(known.where("grade = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").select("grade", "text")
    got = rows.mapInArrow(_sparse, "grade int, columns array<int>, values array<float>").toArrow()
    grade = got.column("grade").to_numpy()
    if not len(grade) or grade.min() == grade.max():
        return None
    lists = got.column("columns").combine_chunks()
    row = np.repeat(np.arange(len(grade)), lists.value_lengths().to_numpy(zero_copy_only=False))
    columns, values = (got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("columns", "values"))
    size = (len(PREFIXES) + 1) << BITS
    scale = log_odds(row, columns, grade, size)
    told = scale[columns] != 0
    row, columns = row[told], columns[told]
    values = values[told] * scale[columns]
    if not len(row):
        return None
    first = fit_ordinal(row, columns, values, grade, size)
    score = np.bincount(row, first.weights[columns] * values, len(grade))
    toxic = np.flatnonzero(grade == 1)
    severity = np.zeros(len(grade), np.int64)
    severity[toxic[np.argsort(score[toxic], kind="stable")]] = 1 + np.arange(len(toxic)) * grades // max(len(toxic), 1)
    model = fit_ordinal(row, columns, values, severity, size)
    return Ordinal((model.weights * scale).astype(np.float32), model.thresholds)


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        data, offsets = column(batch, "text")
        for lo, hi in pieces(offsets):
            text, feature, tokens = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            score = np.bincount(text, model.weights[feature], hi - lo) * 100 / np.maximum(tokens, 1)
            severity = np.where(tokens > 0, model.expected(score), 0.0)
            yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(severity)], [*batch.schema.names, "severity"])


def toxicity(docs: DataFrame, model: Ordinal | None, reject: float = REJECT) -> DataFrame:
    """docs (text, and more columns, which stay) with severity (expected grade) and toxic (severity >= reject).

    Null, empty and blank texts have severity 0, as all have without a model. Repeated rows keep a row each; an empty
    table gives an empty result. Columns of docs named severity or toxic give way to those of the result.
    """
    docs = without(docs, "severity", "toxic")
    if model is None:
        return docs.withColumn("severity", F.lit(0.0)).withColumn("toxic", F.lit(False))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField("severity", DoubleType())])
    return docs.mapInArrow(partial(_scored, model=held), schema).withColumn("toxic", F.col("severity") >= reject)


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "toxic")
