"""Reports: import counts and logs, back-fills, metric text, throughput, expiry, backups, alerts over all keys, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as P
from pyspark.sql.window import Window

from ..functions.text import hash_embedding
from .events import MICROS
from .ranks import floor_percentiles

SECONDS_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
# First and last part of a cache key where none are given.
PREFIX, VERSION = "kb", "v1"


def backfill(docs: DataFrame, dims: int = 1024) -> DataFrame:
    """docs (title, text, embedding) with `updated`: missing embeddings are made from title and text; a row without text stays as it is."""
    made = hash_embedding(F.concat("title", F.lit("\n"), "text"), dims)
    return docs.withColumn("updated", F.col("embedding").isNull() & F.col("text").isNotNull()).withColumn("embedding", F.coalesce("embedding", F.when(F.col("text").isNotNull(), made)))


def backfill_counts(docs: DataFrame) -> DataFrame:
    """total (rows without an embedding), updated, failed (those that can't have one)."""
    missing = F.col("embedding").isNull()
    return docs.agg(F.count_if(missing).alias("total"), F.count_if(missing & F.col("text").isNotNull()).alias("updated"), F.count_if(missing & F.col("text").isNull()).alias("failed"))


def valid_tags(tags: Column, most: int = 10) -> Column:
    """Whether a document has no more tags than an insert allows; none is fine."""
    return F.coalesce(F.size(tags), F.lit(0)) <= most


def import_counts(incoming: DataFrame, existing: DataFrame, category: str, title: str = "title", limit: int | None = None) -> DataFrame:
    """category, seen, imported, skipped: titles that are there already, or came before in the same import, are skipped.

    incoming: category, title, order. limit: so many rows of a category, the first by order, are read.
    """
    rows = incoming
    if limit is not None:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(category).orderBy("order"))).where(F.col("_k") <= limit).drop("_k")
    fresh = rows.groupBy(title).agg(F.min(F.struct("order", category)).alias("_f")).join(existing.select(title), title, "left_anti").groupBy(F.col(f"_f.{category}").alias(category)).agg(F.count("*").alias("imported"))
    seen = rows.groupBy(category).agg(F.count("*").alias("seen"))
    joined = seen.join(fresh, category, "left").withColumn("imported", F.coalesce("imported", F.lit(0).cast("long")))
    return joined.select(category, "seen", "imported", (F.col("seen") - F.col("imported")).alias("skipped"))


def bad_rows(df: DataFrame, problems: dict[str, Column], key: str, most: int = 100) -> DataFrame:
    """key, error: the first `most` rows that have a problem, by key, with the first problem that holds."""
    error = F.coalesce(*[F.when(c, F.lit(name)) for name, c in problems.items()])
    return df.select(key, error.alias("error")).where("error is not null").orderBy(key).limit(most)


def json_report(row: DataFrame) -> DataFrame:
    """value: each row as one line of JSON, nulls included."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def exposition_lines(metric: str, kind: str, values: DataFrame, labels: list[str]) -> DataFrame:
    """metric, ordinal, value: the lines of a counter or gauge (labels, value) in the text format of metric scrapers; labels are sorted by name."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in sorted(labels)])
    head = values.sparkSession.createDataFrame([(metric, 0, f"# TYPE {metric} {kind}")], "metric string, ordinal int, value string")
    name = F.concat(F.lit(metric + "{"), pairs, F.lit("} ")) if labels else F.lit(metric + " ")
    return head.unionByName(values.select(F.lit(metric).alias("metric"), F.lit(1).alias("ordinal"), F.concat(name, F.col("value").cast("string")).alias("value")))


def histogram_lines(metric: str, hist: DataFrame, key: str) -> DataFrame:
    """metric, ordinal, value: TYPE, buckets, sum and count of a histogram (key, bucket, count, sum)."""
    le = F.regexp_replace(F.regexp_replace("bucket", "^le_", ""), "^inf$", "+Inf")
    head = hist.sparkSession.createDataFrame([(metric, 0, f"# TYPE {metric} histogram")], "metric string, ordinal int, value string")
    of = lambda text: F.concat(F.lit(f'{metric}{text}{{{key}="'), F.col(key))
    buckets = hist.select(F.lit(metric).alias("metric"), F.lit(1).alias("ordinal"), F.concat(of("_bucket"), F.lit('",le="'), le, F.lit('"} '), F.col("count").cast("string")).alias("value"))
    last = hist.where("bucket = 'le_inf'")
    sums = last.select(F.lit(metric).alias("metric"), F.lit(2).alias("ordinal"), F.concat(of("_sum"), F.lit('"} '), F.format_string("%.4f", "sum")).alias("value"))
    counts = last.select(F.lit(metric).alias("metric"), F.lit(3).alias("ordinal"), F.concat(of("_count"), F.lit('"} '), F.col("count").cast("string")).alias("value"))
    return head.unionByName(buckets).unionByName(sums).unionByName(counts)


def attack_windows(df: DataFrame, kinds: dict[str, int], kind: str, ip: str, seconds: int = 600, time: str = "micros") -> DataFrame:
    """kind, alerts, worst, top_ip: for each kind of event, over all keys, how many rows end a window of `seconds` with at
    least so many events, the largest count, and the address with the most events (the least on a tie).

    Events are counted by time first. A row adds its count at its time and takes it away once a window that ends there no
    longer holds it, so a window's count is a running sum and no window is gone through again. A bucket of `seconds` needs
    the rows of the one before it only, so a kind that makes up all rows is spread by bucket. Rows without a time are all at
    the same one.
    """
    width = seconds * MICROS
    rows = df.where(F.col(kind).isin(list(kinds)))
    at = rows.groupBy(kind, time).agg(F.count("*").alias("_own")).withColumn("_b", F.floor(F.col(time) / width))
    own = at.select(kind, time, "_b", "_own", F.col("_own").alias("_step"))
    before = at.where(F.col(time).isNotNull()).withColumn("_b", F.col("_b") + 1)
    came = before.select(kind, time, "_b", F.lit(0).cast("long").alias("_own"), F.col("_own").alias("_step"))
    gone = before.select(kind, (F.col(time) + F.lit(width + 1)).alias(time), "_b", F.lit(0).cast("long").alias("_own"), (-F.col("_own")).alias("_step"))
    w = Window.partitionBy(kind, "_b").orderBy(time)
    counted = own.unionByName(came).unionByName(gone).withColumn("n", F.sum("_step").over(w)).where("_own > 0")
    least = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col(kind))
    alerts = counted.where(F.col("n") >= least).groupBy(kind).agg(F.sum("_own").alias("alerts"), F.max("n").alias("worst"))
    per = rows.where(F.col(ip).isNotNull()).groupBy(kind, ip).agg(F.count("*").alias("_n"))
    top = per.groupBy(kind).agg(F.min_by(ip, F.struct((-F.col("_n")).alias("n"), F.col(ip).alias("ip"))).alias("top_ip"))
    return alerts.join(top, kind, "left")


def resolve_alerts(alerts: DataFrame, resolutions: DataFrame, key: str = "alert_id") -> DataFrame:
    """alerts with resolved, notes: the latest resolution (key, notes, at) of each; alerts without one stay open, resolutions without an alert are dropped."""
    last = resolutions.groupBy(key).agg(F.max_by("notes", "at").alias("notes"))
    return alerts.join(last.withColumn("resolved", F.lit(True)), key, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def throughput(df: DataFrame, level: str, ok: Column, time: str, value: str) -> DataFrame:
    """level, requests, rps (successes a second between the first and the last one), mean, p95 (at index floor(0.95 n) of the sorted values)."""
    p95 = floor_percentiles(df, [level], value, {"p95": 0.95}, offset=0).drop("n")
    span = (F.max(time) - F.min(time)) / F.lit(float(MICROS))
    basic = df.groupBy(level).agg(F.count("*").alias("requests"), (F.count_if(ok) / F.greatest(span, F.lit(1.0))).alias("rps"), F.avg(value).alias("mean"))
    return basic.join(p95, level)


def cache_key(resource: Column, kind: Column, identifier: Column, version: str = VERSION, prefix: str = PREFIX) -> Column:
    return F.concat_ws(":", F.lit(prefix), resource, kind, identifier, F.lit(version))


def cache_key_parts(key: Column, prefix: str = PREFIX) -> Column:
    """(resource, data_type, identifier, version) of a key; null where it has another prefix or fewer parts."""
    p = F.split(key, ":")
    parts = F.struct(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("resource", "data_type", "identifier", "version"), 1)])
    return F.when((F.size(p) >= 5) & (F.get(p, F.lit(0)) == prefix), parts)


def glob_match(name: Column, pattern: str) -> Column:
    """Whether a name matches a pattern with * and ?."""
    regex = "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in pattern)
    return F.rlike(name, F.lit(f"(?s)^{regex}$"))


def cacheable(path: Column, method: Column, exclude: tuple = (), exclude_prefixes: tuple = (), paths: tuple = (), prefixes: tuple = ()) -> Column:
    """GET requests that are not excluded; where paths or prefixes are named, only those."""
    starts = lambda ps: F.coalesce(*[F.when(F.startswith(path, F.lit(p)), True) for p in ps], F.lit(False)) if ps else F.lit(False)
    named = (path.isin(*paths) if paths else F.lit(False)) | starts(prefixes)
    excluded = (path.isin(*exclude) if exclude else F.lit(False)) | starts(exclude_prefixes)
    return (method == "GET") & ~excluded & (named if paths or prefixes else F.lit(True))


def check_arguments(**bounds: tuple) -> None:
    """Each value is (value, least, most): numbers by size, texts by length; an error names the first one outside."""
    for name, (value, least, most) in bounds.items():
        size = len(value) if isinstance(value, str) else value
        if value is None or not least <= size <= most:
            raise ValueError(f"{name} must be between {least} and {most}")


def like_any(df: DataFrame, columns: list[str], patterns: list[str], also: Column | None = None) -> DataFrame:
    """Rows where any column holds any of the words, and `also` holds."""
    found = F.lit(False)
    for c in columns:
        for p in patterns:
            found = found | F.contains(c, F.lit(p))
    return df.where(found if also is None else found & also)


def like_any_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], patterns: list[str], also: str = "true", **options: str) -> DataFrame:
    """The like over a database table; the filter is part of the query that the database runs."""
    hits = " OR ".join("{} LIKE '%{}%'".format(c, p.replace("'", "''")) for c in columns for p in patterns)
    return spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {table} WHERE ({hits}) AND ({also})", **options).load()


def schema_text(df: DataFrame) -> str:
    """Column names and types, in order."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)


def content_checksum(df: DataFrame) -> DataFrame:
    """rows, checksum of a table: the schema in order, and a sum over the rows' hashes, which no order of rows changes."""
    row = F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.lit(schema_text(df)), F.count("*").cast("string"), F.coalesce(part(1), F.lit("0")), F.coalesce(part(13), F.lit("0"))), 256).alias("checksum"))


def gate(df: DataFrame, text: str, least: int) -> DataFrame:
    """Rows whose extracted text is longer than `least` characters."""
    return df.where(F.length(text) > least)


def static_rows(spark: SparkSession, rows: list[tuple], schema: str | P.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)
