"""Ranked retrieval: BM25, exact cosine top-k, reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, occurrences, token_count
from ..sources.stored import stored
from .postings import K1, B, term_frequencies

RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 60, 0.6, 0.4


def document_frequencies(docs: DataFrame) -> DataFrame:
    return term_frequencies(docs).groupBy("term").agg(F.count("*").alias("df"))


def _score(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(docs: DataFrame, query: list[str], where=None, key: str = "doc_id") -> DataFrame:
    """key and score of the rows above 0.

    Corpus statistics are those of all rows, also where `where` narrows the result. A term that the query repeats counts as
    often. Texts are read once: their lengths and the counts of the query's terms are stored, a number for each distinct
    term, and both the statistics (one row) and the scores come from there.
    """
    if not query:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    terms = list(dict.fromkeys(query))
    text = F.col("text")
    counts = [occurrences(text, t).alias(f"_tf{i}") for i, t in enumerate(terms)]
    counted = stored(docs.select(key, (F.lit(True) if where is None else where).alias("_in"), token_count(text).alias("_dl"), *counts), "bm25")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i, term in enumerate(terms):
        tf = F.col(f"_tf{i}")
        score = score + F.when(tf > 0, query.count(term) * _score(tf, F.col(f"_df{i}"), F.col("_n"), F.col("_dl"), F.col("_avg"))).otherwise(F.lit(0.0))
    hit = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("_tf0")
    return counted.where(F.col("_in") & (hit > 0)).join(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")


def nearest(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.0, key: str = "vec_id") -> DataFrame:
    """The k most similar rows; those below the threshold are left out after the limit, so fewer than k can stay."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where("embedding is not null").select(key, cosine(F.col("embedding"), q).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), key).limit(k).where(F.col("similarity") >= threshold)


def fuse(vector: DataFrame, lexical: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (key, similarity) and (key, score), each already cut to its best rows."""
    ranked = lambda df, by, name: df.select(key, (F.row_number().over(Window.orderBy(F.desc(by), key)) - 1).alias(name))
    both = ranked(vector, "similarity", "rank_v").join(ranked(lexical, "score", "rank_b"), key, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(RRF_K) + F.col(r)), F.lit(0.0))
    return both.withColumn("score", part(VECTOR_WEIGHT, "rank_v") + part(BM25_WEIGHT, "rank_b")).orderBy(F.desc("score"), key).limit(k)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """The column scaled to 0..1; 1 where all are equal. The extremes are one aggregated row."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(F.broadcast(ends)).withColumn("normalised", scaled).drop("_lo", "_hi")


def hybrid(vector: DataFrame, lexical: DataFrame, k: int, use_vector: bool = True, use_bm25: bool = True, key: str = "id") -> DataFrame:
    """key, score: fused where both sides are used; else the rows of the one side, and none where both are switched off."""
    if use_vector and use_bm25:
        return fuse(vector, lexical, k, key).select(key, "score")
    side = vector.withColumnRenamed("similarity", "score") if use_vector else lexical if use_bm25 else lexical.where("false")
    return side.select(key, "score").orderBy(F.desc("score"), key).limit(k)
