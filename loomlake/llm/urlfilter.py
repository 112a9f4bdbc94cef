"""URL filters by temporal list join.

Dated list entries (pattern, action, day) become validity intervals, and each capture is held against the entries that
were active on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, without

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def url_keys(url: Column) -> Column:
    """Every pattern that can list a URL: its host, the host's parent domains down to two labels, and host/directory/ prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))).otherwise(F.array().cast("array<string>"))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)", 1)
    parts = F.split(path, "/")
    m = F.size(parts)
    folders = F.when(m > 2, F.transform(F.sequence(F.lit(2), m - 1), lambda k: F.concat(host, F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(host), domains, folders)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """pattern, spans: the [start, end) day spans in which a pattern is listed; an open span ends with null.

    entries: pattern, action ('add' or 'remove'), day. An entry holds until the pattern's next one. On one day the removal
    wins; equal entries count once; entries with a null pattern or day are void.
    """
    daily = entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull()).groupBy("pattern", "day").agg(F.bool_and(F.col("action") == "add").alias("listed"))
    order = Window.partitionBy("pattern").orderBy("day")
    return (
        daily.withColumn("until", F.lead("day").over(order))
        .where("listed")
        .groupBy("pattern")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("day").alias("start"), F.col("until").alias("end")))).alias("spans"))
    )


def temporal_url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures with host, n_active (patterns that list the URL on its day), listed_by (the least of them) and blocked.

    captures: page_id, url, fetched, and more columns, which stay. A null or hostless URL, or a null day, meets no entry
    and is not blocked. Repeated captures keep a row each, an empty table or list gives an empty result or one without
    hits. Columns of captures named as those of the result (or _salt, pattern) give way. The list side has one row per pattern, copied to each salt, so
    that a host with a third of all captures is spread over SALTS tasks; whether it is broadcast is left to Spark's size check.
    """
    captures = without(captures, "host", "n_active", "listed_by", "blocked", "_salt", "pattern")
    spans = validity_intervals(entries).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = (
        captures.select("url", "fetched")
        .where("url is not null and fetched is not null")
        .distinct()
        .withColumn("_salt", F.pmod(F.xxhash64("url", "fetched"), F.lit(SALTS)).cast("int"))
        .withColumn("pattern", F.explode(url_keys(F.col("url"))))
    )
    active = keys.join(spans, ["pattern", "_salt"]).where(F.exists("spans", lambda s: (s["start"] <= F.col("fetched")) & (s["end"].isNull() | (F.col("fetched") < s["end"]))))
    hits = active.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.min("pattern").alias("listed_by"))
    known = F.col("url").isNotNull() & F.col("fetched").isNotNull()
    without_key = captures.where(~known).withColumn("n_active", F.lit(None).cast("long")).withColumn("listed_by", F.lit(None).cast("string"))  # these would meet in one task
    return (
        captures.where(known)
        .join(hits, ["url", "fetched"], "left")
        .unionByName(without_key)
        .withColumn("host", host_of(F.col("url")))
        .withColumn("n_active", F.coalesce("n_active", F.lit(0).cast("long")))
        .withColumn("blocked", F.col("n_active") > 0)
    )


def dated_list(pages: DataFrame) -> DataFrame:
    """The list that the query uses, as the tables hold none: by a rule over the hosts seen, entries that come, go and come back."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    k = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c)
    entry = lambda when, pattern, action, at: F.when(when, F.struct(pattern.alias("pattern"), F.lit(action).alias("action"), day(at).alias("day")))
    listed = hosts.withColumn("k", k).select(
        F.explode(
            F.array(
                entry(F.col("k") % 4 == 0, F.col("host"), "add", F.col("k") % 300),
                entry(F.col("k") % 4 == 0, F.col("host"), "remove", F.col("k") % 300 + 45),
                entry(F.col("k") % 8 == 0, F.col("host"), "add", F.col("k") % 300 + 90),
                entry(F.col("k") % 16 == 3, F.concat("host", F.lit("/en/")), "add", F.col("k") % 200),
            )
        ).alias("e")
    )
    fixed = pages.sparkSession.sql("select * from values ('spam-farm.example.org', 'add', date'2024-01-01'), ('spam-farm.example.org', 'remove', date'2024-07-01'), ('spam-farm.example.org', 'add', date'2024-08-01') as t(pattern, action, day)")
    return listed.where("e is not null").select("e.pattern", "e.action", "e.day").unionByName(fixed)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture; the fetch day, which the table lacks, follows from page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    out = temporal_url_filter(captures, dated_list(pages))
    return out.select("page_id", "host", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "n_active", "listed_by", "blocked")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.'), '') AS host,
         string_split(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), '/') AS parts
  FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS k FROM p WHERE host IS NOT NULL),
e AS (
  SELECT host AS pattern, 'add' AS action, DATE '2024-01-01' + k % 300 AS day FROM h WHERE k % 4 = 0
  UNION ALL SELECT host, 'remove', DATE '2024-01-01' + (k % 300 + 45) FROM h WHERE k % 4 = 0
  UNION ALL SELECT host, 'add', DATE '2024-01-01' + (k % 300 + 90) FROM h WHERE k % 8 = 0
  UNION ALL SELECT host || '/en/', 'add', DATE '2024-01-01' + k % 200 FROM h WHERE k % 16 = 3
  UNION ALL SELECT * FROM (VALUES ('spam-farm.example.org', 'add', DATE '2024-01-01'), ('spam-farm.example.org', 'remove', DATE '2024-07-01'), ('spam-farm.example.org', 'add', DATE '2024-08-01')) t(a, b, c)),
d AS (SELECT pattern, day, bool_and(action = 'add') AS listed FROM e GROUP BY 1, 2),
i AS (SELECT pattern, day, listed, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM d),
keys AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat([host],
    [array_to_string(list_slice(string_split(host, '.'), x, -1), '.') FOR x IN range(2, len(string_split(host, '.')))],
    [host || array_to_string(list_slice(parts, 1, x), '/') || '/' FOR x IN range(2, len(parts))])) AS pattern
  FROM p WHERE host IS NOT NULL),
hits AS (
  SELECT page_id, count(*) AS n_active, min(k.pattern) AS listed_by FROM keys k
  JOIN i ON i.pattern = k.pattern AND i.listed AND i.day <= k.fetched AND (i.until IS NULL OR k.fetched < i.until) GROUP BY 1)
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(n_active, 0) AS n_active, listed_by, n_active IS NOT NULL AS blocked
FROM p LEFT JOIN hits USING (page_id)
"""
