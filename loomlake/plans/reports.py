"""Report queries: imports, back-fills, metric text, quality sections, alerts over all keys, statistics of services, cache keys."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import events as E
from ..operators import metrics as M
from ..operators import quality
from ..operators import reports as R
from ..sources import samples
from ..sources.tables import import_fields, import_records, listed_documents, table, tables_of
from .analytics import _requests
from .documents import TITLE, email_sql
from .named import collector

QUERIES, ORACLES, query = collector()

DAY = 86400


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return table(spark, d, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"), "text").join(v, "doc_id", "left")


@query("SELECT count(*) AS total, count(text) AS updated, count(*) - count(text) AS failed FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL")
def embedding_backfill_counts(spark, d):
    return R.backfill_counts(_vectors(spark, d))


@query(
    f"""SELECT doc_id, embedding IS NULL AND text IS NOT NULL AS updated, round(CASE WHEN embedding IS NOT NULL THEN embedding[1]::DOUBLE ELSE v[1] / sqrt(32 * list_sum(list_transform(v, lambda x: x * x))) END, 6) AS d0
FROM (SELECT doc_id, text, embedding, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(sha256({TITLE} || chr(10) || text), 2 * i + 1, 2) AS INTEGER) / 255.0::DOUBLE - 0.5) * 2) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
)
def embedding_backfill(spark, d):
    return R.backfill(_vectors(spark, d)).select("doc_id", "updated", F.round(F.get("embedding", F.lit(0)), 6).alias("d0"))


@query(
    f"""WITH r AS (SELECT lang AS category, {TITLE} AS title, doc_id AS o FROM documents WHERE text IS NOT NULL), f AS (SELECT arg_min(category, o) AS category FROM r WHERE title NOT IN (SELECT {TITLE} FROM benchmark WHERE text IS NOT NULL) GROUP BY title)
SELECT category, seen, coalesce(imported, 0) AS imported, seen - coalesce(imported, 0) AS skipped FROM (SELECT category, count(*) AS seen FROM r GROUP BY category) LEFT JOIN (SELECT category, count(*) AS imported FROM f GROUP BY category) USING (category)"""
)
def import_counts(spark, d):
    title = T.title_of(F.col("text")).alias("title")
    rows = table(spark, d, "documents").where("text is not null").select(F.col("lang").alias("category"), title, F.col("doc_id").alias("order"))
    return R.import_counts(rows, table(spark, d, "benchmark").where("text is not null").select(title), "category")


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN 'no content' WHEN length(text) < 60 THEN 'content too short' WHEN length({TITLE}) > 500 THEN 'title too long' END AS error FROM documents WHERE text IS NULL OR length(text) < 60 OR length({TITLE}) > 500 ORDER BY doc_id LIMIT 100")
def import_errors(spark, d):
    """The log keeps the first 100."""
    title = T.title_of(F.col("text"))
    problems = {"no content": F.col("text").isNull(), "content too short": F.length("text") < 60, "title too long": F.length(title) > 500}
    return R.bad_rows(table(spark, d, "documents"), problems, "doc_id")


@query("""SELECT '{"source":"' || source || '","documents":' || count(*) || ',"characters":' || sum(n_chars)::BIGINT || ',"languages":' || count(DISTINCT lang) || '}' AS value FROM documents GROUP BY source""")
def json_report(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.countDistinct("lang").alias("languages"))
    return R.json_report(per)


BOUNDS = [*R.SECONDS_BOUNDS]
_BUCKETS = [(f"{b:g}", f"value / 100 <= {b}") for b in BOUNDS] + [("+Inf", "value IS NOT NULL")]
_OBSERVED = "FROM events GROUP BY event_type"


@query(
    "SELECT '# TYPE seconds histogram' AS value UNION ALL "
    + " UNION ALL ".join(f"""SELECT 'seconds_bucket{{type="' || event_type || '",le="{b}"}} ' || count(*) FILTER ({c}) {_OBSERVED}""" for b, c in _BUCKETS)
    + f""" UNION ALL SELECT 'seconds_sum{{type="' || event_type || '"}} ' || printf('%.4f', sum(value / 100)) {_OBSERVED} UNION ALL SELECT 'seconds_count{{type="' || event_type || '"}} ' || count(value) {_OBSERVED}"""
)
def metrics_text(spark, d):
    """Twelve buckets up to infinity, with TYPE, sum and count."""
    seen = table(spark, d, "events").select(F.col("event_type").alias("type"), (F.col("value") / 100).alias("s"))
    return R.histogram_lines("seconds", M.histogram(seen, ["type"], "s", R.SECONDS_BOUNDS), "type").select("value")


@query(
    """SELECT '# TYPE requests_total counter' AS value UNION ALL SELECT 'requests_total{method="' || event_type || '",shard="' || user_id % 4 || '"} ' || count(*) FROM events GROUP BY event_type, user_id % 4
UNION ALL SELECT '# TYPE errors_total counter' UNION ALL SELECT 'errors_total{shard="' || user_id % 4 || '"} ' || count(*) FILTER (event_type = 'error') FROM events GROUP BY user_id % 4"""
)
def labelled_metrics(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("shard"))
    requests = R.exposition_lines("requests_total", "counter", e.groupBy("method", "shard").agg(F.count("*").alias("value")), ["shard", "method"])
    errors = R.exposition_lines("errors_total", "counter", e.groupBy("shard").agg(F.count_if(F.col("method") == "error").alias("value")), ["shard"])
    return requests.unionByName(errors).select("value")


# Section, table, rule and the SQL of what breaks it, in the form of a rule table.
RULES = [
    ("users", "customer", "name required", "c_name IS NULL"),
    ("users", "customer", "name length", "length(c_name) < 3 OR length(c_name) > 50"),
    ("users", "customer", "balance", "c_acctbal < 0"),
    ("documents", "documents", "text required", "text IS NULL"),
    ("documents", "documents", "content length", "length(text) < 10"),
    ("documents", "documents", "extension", "lang NOT IN ('en', 'de', 'es', 'fr')"),
    ("documents", "documents", "size", "n_chars < 0 OR n_chars > 52428800"),
    ("pages", "pages", "url required", "url IS NULL"),
    ("pages", "pages", "size", "length(html) < 100 OR length(html) > 10000"),
    ("annotations", "labels", "document required", "doc_id IS NULL"),
    ("annotations", "labels", "range", "quality NOT IN (0, 1) OR toxic NOT IN (0, 1)"),
    ("search_history", "events", "user required", "user_id IS NULL"),
    ("search_history", "events", "response time", "value < 0"),
    ("processing_jobs", "orders", "status", "o_orderstatus NOT IN ('F', 'O', 'P')"),
    ("processing_jobs", "orders", "total", "o_totalprice <= 0"),
    ("conversations", "conversations", "role", "role NOT IN ('user', 'assistant', 'system')"),
    ("conversations", "conversations", "empty", "length(text) = 0"),
]
_KEYS = [("users", "customer", "c_custkey"), ("documents", "documents", "text"), ("pages", "pages", "url")]
_LINKS = [("annotations", "labels", "doc_id", "documents", "doc_id"), ("processing_jobs", "orders", "o_custkey", "customer", "c_custkey")]
_FAILED = " UNION ALL ".join(
    [f"SELECT '{s}' AS section, '{r}' AS rule, count(*) FILTER ({c}) AS failed FROM {t}" for s, t, r, c in RULES]
    + [f"SELECT '{s}', 'unique {c}', count(*) FROM (SELECT {c} FROM {t} GROUP BY {c} HAVING count(*) > 1)" for s, t, c in _KEYS]
    + [f"SELECT '{s}', 'orphan {c}', count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)" for s, t, c, p, k in _LINKS]
)


def _failed(spark, d):
    """section, rule, failed: the row-wise rules of a table in one pass each, then the unique keys and the links."""
    out = None
    for t in dict.fromkeys(t for _, t, _, _ in RULES):
        own = [(s, r, c) for s, of, r, c in RULES if of == t]
        part = quality.failing(table(spark, d, t), {r: F.expr(c) for _, r, c in own}).select(F.lit(own[0][0]).alias("section"), F.col("check").alias("rule"), "failed")
        out = part if out is None else out.unionByName(part)
    for s, t, c in _KEYS:
        out = out.unionByName(quality.duplicates(table(spark, d, t), c).agg(F.lit(s).alias("section"), F.lit(f"unique {c}").alias("rule"), F.count("*").alias("failed")))
    for s, t, c, p, k in _LINKS:
        out = out.unionByName(quality.orphans(table(spark, d, t).select(c), c, table(spark, d, p), k).agg(F.lit(s).alias("section"), F.lit(f"orphan {c}").alias("rule"), F.count("*").alias("failed")))
    return out


@query(_FAILED)
def quality_rules(spark, d):
    return _failed(spark, d)


@query(f"WITH s AS (SELECT section, count(*) FILTER (failed = 0) / count(*) * 100 AS score FROM ({_FAILED}) GROUP BY section) SELECT section, round(score, 2) AS score, round((SELECT avg(score) FROM s), 2) AS overall FROM s")
def quality_sections(spark, d):
    """Seven sections; the overall score is their unweighted mean."""
    s = quality.scores(_failed(spark, d))
    return s.select("section", F.round("score", 2).alias("score")).join(s.agg(F.round(F.avg("score"), 2).alias("overall")))


_KINDS = {"error": 3, "purchase": 5}
_WIDE = 6 * 3600


@query(
    f"""WITH n AS (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN {_WIDE * E.MICROS} PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type IN ('error', 'purchase')),
a AS (SELECT event_type, count(*) AS alerts, max(n) AS worst FROM n WHERE n >= CASE event_type WHEN 'error' THEN 3 ELSE 5 END GROUP BY event_type),
i AS (SELECT event_type, 'ip' || user_id % 7 AS ip, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL)
SELECT event_type, alerts, worst, (SELECT ip FROM i WHERE i.event_type = a.event_type ORDER BY n DESC, ip LIMIT 1) AS top_ip FROM a"""
)
def attack_windows(spark, d):
    rows = _requests(spark, d).withColumn("ip", F.concat(F.lit("ip"), (F.col("user_id") % 7).cast("string")))
    return R.attack_windows(rows, _KINDS, "event_type", "ip", _WIDE)


_COOL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, event_id, k, t AS last, true AS sent FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.last > 259200000000 THEN e.t ELSE r.last END, e.t - r.last > 259200000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, sent FROM r"""


@query(_COOL)
def alert_cooldown(spark, d):
    """An alert is sent again only when more than three days have gone since the last one that was."""
    rows = _requests(spark, d).where("event_type = 'error'")
    return E.ordered_fold(rows, "user_id", "micros", "event_id", E.cooldown(3 * DAY), [], "sent", "boolean", gap=3 * DAY).select("event_id", "sent")


@query("SELECT a.event_id AS alert_id, a.user_id, r.notes, r.notes IS NOT NULL AS resolved FROM events a LEFT JOIN (SELECT user_id * 10 AS event_id, arg_max('note ' || event_id, event_id) AS notes FROM events WHERE event_type = 'signup' GROUP BY user_id) r USING (event_id) WHERE a.event_type = 'error'")
def alert_resolution(spark, d):
    e = table(spark, d, "events")
    alerts = e.where("event_type = 'error'").select(F.col("event_id").alias("alert_id"), "user_id")
    answers = e.where("event_type = 'signup'").select((F.col("user_id") * 10).alias("alert_id"), F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes"), F.col("event_id").alias("at"))
    return R.resolve_alerts(alerts, answers)


@query("WITH m AS (SELECT max(ts) AS now FROM events), k AS (SELECT user_id, count(*) AS hits, max(ts) AS last FROM events GROUP BY user_id) SELECT count(*) AS entries, count(*) FILTER (last < now - INTERVAL 12 HOUR) AS expired, count(*) FILTER (last >= now - INTERVAL 12 HOUR) AS active, count(*) FILTER (hits > 10) AS hot FROM k, m")
def expiry_stats(spark, d):
    e = table(spark, d, "events")
    k = e.groupBy("user_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last")).join(e.agg(F.max("ts").alias("now")))
    old = F.col("last") < F.col("now") - F.expr("interval 12 hours")
    return k.agg(F.count("*").alias("entries"), F.count_if(old).alias("expired"), F.count_if(~old).alias("active"), F.count_if(F.col("hits") > 10).alias("hot"))


@query("SELECT event_type AS domain, count(*) AS requests, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(avg(value), 6) AS routing_ms FROM events GROUP BY event_type")
def gateway_stats(spark, d):
    e = table(spark, d, "events")
    per = e.groupBy(F.col("event_type").alias("domain")).agg(F.count("*").alias("requests"), F.round(F.avg("value"), 6).alias("routing_ms"))
    return per.join(e.agg(F.count("*").alias("_all"))).select("domain", "requests", F.round(F.col("requests") / F.col("_all"), 6).alias("share"), "routing_ms")


@query("SELECT count(DISTINCT event_type) AS domains, count(*) AS queries, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms FROM events")
def domain_rollup(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("event_type").alias("domains"), F.count("*").alias("queries"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("SELECT o_orderstatus AS kind, count(*) AS backups, round(sum(o_totalprice) / 1048576, 6) AS total_mb, round(avg(o_totalprice), 4) AS mean_bytes, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus")
def backup_stats(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind"))
    return o.agg(F.count("*").alias("backups"), F.round(F.sum("o_totalprice") / 1048576, 6).alias("total_mb"), F.round(F.avg("o_totalprice"), 4).alias("mean_bytes"), F.max("o_orderdate").alias("last"))


@query("SELECT o_orderkey, o_totalprice, round(avg(o_totalprice) OVER (ORDER BY o_orderdate DESC, o_orderkey DESC), 4) AS running FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)")
def latest_backups(spark, d):
    """The last ten, with the running mean of their sizes."""
    from pyspark.sql.window import Window

    order = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    last = table(spark, d, "orders").orderBy(*order).limit(10)
    return last.select("o_orderkey", "o_totalprice", F.round(F.avg("o_totalprice").over(Window.orderBy(*order)), 4).alias("running"))


_P95 = "list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS INTEGER) + 1]"


@query(f"SELECT user_id % 5 AS level, count(*) AS requests, round(count(*) FILTER (event_type <> 'error') / greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE, 1), 9) AS rps, round(avg(value), 6) AS mean, {_P95} AS p95 FROM events GROUP BY 1")
def throughput_by_level(spark, d):
    rows = _requests(spark, d).withColumn("level", F.col("user_id") % 5)
    return R.throughput(rows, "level", F.col("event_type") != "error", "micros", "value").select("level", "requests", F.round("rps", 9).alias("rps"), F.round("mean", 6).alias("mean"), "p95")


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate, round(100 * count(*) FILTER (event_type <> 'error') / count(*), 4)::DOUBLE AS success_rate FROM events GROUP BY user_id")
def failure_rates(spark, d):
    failed = F.count_if(F.col("event_type") == "error")
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), failed.alias("failed"))
    return per.select("user_id", "calls", "failed", F.round(F.col("failed") / F.col("calls"), 6).alias("failure_rate"), F.round(100 * (F.col("calls") - F.col("failed")) / F.col("calls"), 4).alias("success_rate"))


@query("SELECT user_id, round(coalesce(avg(value - 100) FILTER (value > 100), 0), 6) AS mean_duration FROM events GROUP BY user_id")
def access_durations(spark, d):
    """The mean of the positive ones, 0 without any."""
    took = F.col("value") - 100
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(took > 0, took)), F.lit(0.0)), 6).alias("mean_duration"))


@query("SELECT page_id, url FROM pages WHERE (contains(url, '/es/') OR contains(url, '/de/') OR contains(html, 'utm_source')) AND page_id >= 0")
def like_any_extract(spark, d):
    return R.like_any(table(spark, d, "pages"), ["url", "html"], ["/es/", "/de/", "utm_source"], F.col("page_id") >= 0).where("contains(url, '/es/') or contains(url, '/de/') or contains(html, 'utm_source')").select("page_id", "url")


@query("SELECT event_type, user_id % 3 AS shard, 'kb:event:' || event_type || ':' || user_id % 3 || ':v1' AS key, event_type AS data_type, event_type LIKE '%r%' AS globbed FROM events GROUP BY ALL")
def cache_keys(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("shard")).distinct()
    keyed = e.withColumn("key", R.cache_key(F.lit("event"), F.col("event_type"), F.col("shard").cast("string")))
    return keyed.select("event_type", "shard", "key", R.cache_key_parts(F.col("key"))["data_type"].alias("data_type"), R.glob_match(F.col("event_type"), "*r*").alias("globbed"))


@query("SELECT event_type IN ('view', 'click') AS cacheable, count(*) AS n FROM events GROUP BY 1")
def cacheable_requests(spark, d):
    path = F.concat(F.lit("/api/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    method = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    return table(spark, d, "events").groupBy(R.cacheable(path, method, exclude=("/api/none",), exclude_prefixes=("/api/signup",), prefixes=("/api/view", "/api/click", "/api/purchase")).alias("cacheable")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE length(text) > 100")
def length_gate(spark, d):
    return R.gate(table(spark, d, "documents"), "text", 100).select("doc_id")


@query("SELECT count(*) AS insertable FROM documents WHERE len(string_split(coalesce(text, ''), chr(10))) <= 10")
def tag_guard(spark, d):
    """Lines stand for tags: a row with more than ten is not inserted."""
    return table(spark, d, "documents").where(R.valid_tags(F.split(F.coalesce("text", F.lit("")), "\n", -1))).agg(F.count("*").alias("insertable"))


@query("SELECT count(*) > 0 AS alive FROM documents")
def liveness(spark, d):
    """Whether the documents can be read and are any."""
    return table(spark, d, "documents").agg((F.count("*") > 0).alias("alive"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES) + " UNION ALL SELECT 'all', " + " + ".join(f"(SELECT count(*) FROM {t})" for t in TABLES))
def row_counts(spark, d):
    """The rows of every table that the folder has, and of all."""
    counts = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in tables_of(spark, d)]
    each = functools.reduce(lambda a, b: a.unionByName(b), counts)
    return each.rollup("table_name").agg(F.sum("n").alias("n")).select(F.coalesce("table_name", F.lit("all")).alias("table_name"), "n")


_DATED = "SELECT user_id, 'query ' || event_id AS query, event_id % 50 AS results_count, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at FROM events"


@query(
    f"""WITH r AS ({_DATED}), c AS (SELECT *, try_cast(created_at AS TIMESTAMP) AS seen FROM r)
SELECT user_id, count(*) FILTER (created_at IS NULL OR seen IS NOT NULL) AS imported, count(*) FILTER (created_at IS NOT NULL AND seen IS NULL) AS errors, max(epoch_us(seen)) AS last, count(*) FILTER (created_at IS NULL) AS undated FROM c GROUP BY user_id"""
)
def import_searches(spark, d):
    """Searches with dates as text, some missing and some that are none: rows with what can't be read go to the errors."""
    k = F.col("event_id")
    said = F.when(k % 9 == 0, F.lit(None)).when(k % 11 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    raw = table(spark, d, "events").select("user_id", F.concat(F.lit("query "), k.cast("string")).alias("query"), (k % 50).cast("string").alias("results_count"), said.alias("created_at"))
    rows, errors = import_records(raw, "search_history")
    kept = rows.groupBy("user_id").agg(F.count("*").alias("imported"), F.max(F.unix_micros("created_at")).alias("last"), F.count_if(F.col("created_at").isNull()).alias("undated"))
    bad = errors.groupBy("user_id").agg(F.count("*").alias("errors"))
    return kept.join(bad, "user_id", "full_outer").na.fill(0, ["imported", "undated", "errors"]).select("user_id", "imported", "errors", "last", "undated")


RELATED = {"click": ["view", "purchase"], "view": ["click"], "signup": ["view"]}
_RELATED_ROWS = [(k, x) for k, xs in RELATED.items() for x in xs]
_RELATED_SQL = " UNION ALL ".join(f"SELECT '{k}' AS event_type, {i} AS i, '{x}' AS related" for i, (k, x) in enumerate(_RELATED_ROWS))


@query(f"SELECT event_type, coalesce(string_agg(related, ',' ORDER BY i), '') AS related FROM (SELECT DISTINCT event_type FROM events) LEFT JOIN ({_RELATED_SQL}) USING (event_type) GROUP BY event_type")
def related_lookup(spark, d):
    """A static map of lists; a key without an entry has an empty list."""
    pairs = [x for k, xs in RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, xs)))]
    found = F.coalesce(F.element_at(F.create_map(*pairs), F.col("event_type")), F.array().cast("array<string>"))
    return table(spark, d, "events").select("event_type").distinct().select("event_type", F.array_join(found, ",").alias("related"))


@query("SELECT r_name AS category, count(*) AS n, min(n_name) AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def static_documents(spark, d):
    """Nations stand for the fixed documents, regions for their categories."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("category")).agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("SELECT doc_id AS id, doc_id AS document_id, doc_id % 5 + 1 AS user_id, ['highlight', 'comment', 'tag'][doc_id % 3 + 1] AS annotation_type, (doc_id * 10) % greatest(n_chars, 1) AS start_offset, least((doc_id * 10) % greatest(n_chars, 1) + 20, n_chars) AS end_offset FROM documents")
def sample_annotations(spark, d):
    """An annotation within each stored document."""
    return samples.annotations_of(table(spark, d, "documents"), users=5)


@query("SELECT 'doc_' || doc_id AS title, ['txt', 'md', 'pdf'][doc_id % 3 + 1] AS extension, doc_id % 5 + 1 AS uploader_id, n_chars AS file_size, 'uploads/doc_' || doc_id || '.' || ['txt', 'md', 'pdf'][doc_id % 3 + 1] AS file_path FROM documents")
def sample_documents(spark, d):
    """The upload record of each stored document."""
    return samples.uploads_of(table(spark, d, "documents"), users=5)


@query(
    """SELECT user_id, enabled AND (granted OR own) AND user_id % 7 <> 3 AS allowed FROM (SELECT c_custkey AS user_id, c_acctbal >= 0 AS enabled, c_nationkey % 3 IN (1, 2) AS granted, c_mktsegment = 'MACHINERY' AS own FROM customer)"""
)
def permissions(spark, d):
    """Permission by a role, or personally, for enabled users, with a condition."""
    roles = F.element_at(F.array(F.array(F.lit("guest")), F.array(F.lit("guest"), F.lit("editor")), F.array(F.lit("admin"))), (F.col("c_nationkey") % 3 + 1).cast("int"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("enabled"), roles.alias("roles"), F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("write"))).alias("permissions"))
    held = spark.createDataFrame([("guest", "read"), ("editor", "write"), ("admin", "write"), ("admin", "delete")], "role string, permission string")
    return quality.allowed(users, held, "write", F.col("user_id") % 7 != 3)


@query("SELECT regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS title, '来源: ' || url AS content, '气功' AS category, 0 AS n_tags FROM pages")
def listed_imports(spark, d):
    rows = listed_documents(table(spark, d, "pages").select(F.col("url").alias("path")), "气功")
    return rows.select("title", "content", "category", F.size("tags").alias("n_tags"))


@query(
    f"""SELECT doc_id, substr(CASE WHEN doc_id % 3 = 0 THEN '无标题' WHEN doc_id % 3 = 1 THEN source ELSE {TITLE} END, 1, 500) AS title, text AS content, lang AS category, lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',x' END AS tags
FROM documents WHERE trim(text) <> ''"""
)
def import_defaults(spark, d):
    """A missing title falls back to the name, then to a fixed one; the category becomes a tag."""
    k = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        k,
        "lang",
        F.when(k % 3 == 2, T.title_of(F.col("text"))).alias("title"),
        F.when(k % 3 == 1, F.col("source")).alias("name"),
        F.lit(None).cast("string").alias("content"),
        F.col("text").alias("description"),
        F.when(k % 2 == 1, F.array(F.lit("x"))).alias("tags"),
    )
    out = import_fields(rows, F.col("lang"), keep=("doc_id",))
    return out.select("doc_id", "title", "content", "category", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("SELECT source || ': ' || count(*) || ' documents, ' || round(avg(n_chars), 1) || ' characters on average' AS value FROM documents GROUP BY source")
def text_report(spark, d):
    per = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 1).alias("mean"))
    return per.select(F.format_string("%s: %d documents, %s characters on average", "source", "n", F.col("mean").cast("string")).alias("value"))


@query(f"SELECT doc_id, {email_sql('text')} AS masked FROM documents WHERE text IS NOT NULL")
def mask_emails(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.mask_emails(F.col("text")).alias("masked"))


@query("SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.2f', s) || ' B' WHEN s < 1048576 THEN printf('%.2f', s / 1024) || ' KB' WHEN s < 1073741824 THEN printf('%.2f', s / 1048576) || ' MB' ELSE printf('%.2f', s / 1073741824) || ' GB' END AS label FROM (SELECT doc_id, (n_chars * n_chars * 7)::DOUBLE AS s FROM documents)")
def size_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", T.size_label(F.col("n_chars") * F.col("n_chars") * 7).alias("label"))


@query(
    """WITH s AS (SELECT doc_id, length(text) AS n, CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 6) AS INTEGER) % 1501 + 500 AS size FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, n, size, unnest(range(0, n, size - size // 10))::INTEGER AS position FROM s)
SELECT doc_id, position // (size - size // 10) AS chunk_index, position, least(size, n - position)::INTEGER AS size FROM p"""
)
def sample_chunks(spark, d):
    return samples.sample_chunks(table(spark, d, "documents").where("text is not null")).select("doc_id", "chunk_index", "position", F.length("content").alias("size"))
