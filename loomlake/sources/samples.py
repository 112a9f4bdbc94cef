"""Made-up rows for imports and load tests; every field is a function of the row's number or of the stored row it belongs to, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(k: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def users_of(ids: DataFrame) -> DataFrame:
    """A user for each row (id)."""
    name = F.concat(F.lit("import_user_"), F.col("id").cast("string"))
    return ids.select(
        name.alias("username"),
        F.concat(name, F.lit("@example.com")).alias("email"),
        F.concat(F.lit("Import User "), F.col("id").cast("string")).alias("full_name"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_admin"),
    )


def sample_users(spark: SparkSession, n: int = 100) -> DataFrame:
    return users_of(spark.range(1, n + 1))


def searches_of(rows: DataFrame, key: str, user: str) -> DataFrame:
    """A search for each row, by its user."""
    k = F.col(key)
    return rows.select(
        F.col(user).alias("user_id"),
        F.concat(F.lit("query "), k.cast("string")).alias("query"),
        F.lit("keyword").alias("search_type"),
        (k % 50).alias("results_count"),
        (k % 1000 + 50).cast("double").alias("response_time_ms"),
    )


def sample_chunks(docs: DataFrame, least: int = 500, most: int = 2000, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, position, content: chunks of a size between `least` and `most` that the key's hash picks, a tenth of it overlapping."""
    size = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("int") % (most - least + 1)) + least
    step = size - F.floor(size / 10).cast("int")
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, step))
    placed = docs.select(key, "text", size.alias("_size"), F.posexplode(starts).alias("chunk_index", "position"))
    return placed.select(key, "chunk_index", "position", F.substring("text", F.col("position") + 1, F.col("_size")).alias("content"))


def uploads_of(docs: DataFrame, users: int = 100, extensions: tuple = ("txt", "md", "pdf"), key: str = "doc_id") -> DataFrame:
    """The upload record of each document (key, n_chars)."""
    k = F.col(key)
    title = F.concat(F.lit("doc_"), k.cast("string"))
    return docs.select(
        title.alias("title"),
        _pick(k, extensions).alias("extension"),
        (k % users + 1).alias("uploader_id"),
        F.col("n_chars").alias("file_size"),
        F.concat(F.lit("uploads/"), title, F.lit("."), _pick(k, extensions)).alias("file_path"),
    )


def annotations_of(docs: DataFrame, users: int = 100, kinds: tuple = ("highlight", "comment", "tag"), key: str = "doc_id") -> DataFrame:
    """An annotation of up to twenty characters within each document (key, n_chars)."""
    k, size = F.col(key), F.col("n_chars")
    start = k * 10 % F.greatest(size, F.lit(1))
    return docs.select(
        k.alias("id"),
        k.alias("document_id"),
        (k % users + 1).alias("user_id"),
        _pick(k, kinds).alias("annotation_type"),
        start.alias("start_offset"),
        F.least(start + 20, size).alias("end_offset"),
    )
