"""Analytics queries: quality checks, joins, latency, metrics, events, tiers."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import events as E
from ..operators import metrics as M
from ..operators import graph, quality, ranks, rules, tiering
from ..operators import reports as R
from ..sources.tables import table
from .named import collector

QUERIES, ORACLES, query = collector()


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey LIMIT 100")
def users_docs_join(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"]).select("c_custkey", "c_name", "o_orderkey").orderBy("o_orderkey").limit(100)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_anti_join(spark, d):
    return quality.orphans(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels"), "doc_id")


@query(
    """SELECT path, pattern, most FROM (SELECT p.path, l.pattern, l.most, row_number() OVER (PARTITION BY p.path ORDER BY (p.path = l.pattern) DESC, l.k) AS r
FROM (SELECT DISTINCT '/api/' || event_type || '/' || user_id % 3 AS path FROM events) p JOIN (VALUES (1, '/api/click', 10), (2, '/api/view/1', 5), (3, '/api/view', 20), (4, '/api', 60)) l(k, pattern, most) ON starts_with(p.path, l.pattern)) WHERE r = 1"""
)
def endpoint_limit_lookup(spark, d):
    limits = [(1, "/api/click", 10), (2, "/api/view/1", 5), (3, "/api/view", 20), (4, "/api", 60)]
    paths = table(spark, d, "events").select(F.concat(F.lit("/api/"), "event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("path")).distinct()
    rules = F.array(*[F.struct((F.col("path") != p).alias("other"), F.lit(k).alias("k"), F.lit(p).alias("pattern"), F.lit(m).alias("most")) for k, p, m in limits])
    best = F.array_min(F.filter(rules, lambda r: F.startswith(F.col("path"), r["pattern"])))
    return paths.withColumn("b", best).select("path", "b.pattern", "b.most")


@query("SELECT count(c_custkey) AS hits, count(*) - count(c_custkey) AS misses FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON user_id = c_custkey")
def batch_lookup(spark, d):
    keys = table(spark, d, "events").select("user_id").distinct()
    found = keys.join(table(spark, d, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey"), "left")
    return found.agg(F.count("c_custkey").alias("hits"), (F.count("*") - F.count("c_custkey")).alias("misses"))


@query(
    """WITH RECURSIVE h(child, parent) AS (SELECT 's' || s_suppkey, 's' || s_suppkey // 2 FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 5 FROM region WHERE r_regionkey < 3),
p(role, perm) AS (SELECT 's' || s_suppkey, 'stock:' || s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'n' || n_nationkey, 'sell:' || n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'read:' || r_name FROM region),
r(role, cur) AS (SELECT child, child FROM h UNION SELECT role, role FROM p UNION SELECT r.role, h.parent FROM r JOIN h ON r.cur = h.child) SELECT DISTINCT r.role, p.perm FROM r JOIN p ON r.cur = p.role"""
)
def role_permissions(spark, d):
    """Permissions that a role has itself or by the roles above it: suppliers report to the supplier of half their number and to their nation, nations to regions."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    supplier, nation, region = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    pairs = lambda df, a, b, names: df.select(a.alias(names[0]), b.alias(names[1]))
    up, own = ("role", "parent"), ("role", "permission")
    parents = (
        pairs(supplier.where("s_suppkey > 1"), named("s", "s_suppkey"), F.concat(F.lit("s"), F.expr("s_suppkey div 2").cast("string")), up)
        .unionByName(pairs(supplier, named("s", "s_suppkey"), named("n", "s_nationkey"), up))
        .unionByName(pairs(nation, named("n", "n_nationkey"), named("r", "n_regionkey"), up))
        .unionByName(pairs(region.where("r_regionkey < 3"), named("r", "r_regionkey"), F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 5).cast("string")), up))
    )
    held = (
        pairs(supplier.where("s_acctbal > 0"), named("s", "s_suppkey"), named("stock:", "s_suppkey"), own)
        .unionByName(pairs(nation, named("n", "n_nationkey"), named("sell:", "n_name"), own))
        .unionByName(pairs(region, named("r", "r_regionkey"), named("read:", "r_name"), own))
    )
    return graph.inherited(held, parents).select("role", F.col("permission").alias("perm"))


_RULES = r"""SELECT DISTINCT prefix, md5(prefix) AS ordinal FROM (SELECT unnest([regexp_extract(url, '^https?://[^/]+/'), regexp_extract(url, '^https?://[^/]+/[a-z]{2}/'), split_part(url, '#', 1)]) AS prefix FROM pages) WHERE prefix <> ''"""


@query(f"WITH r AS ({_RULES}) SELECT page_id, arg_min(prefix, CASE WHEN prefix = url THEN '0' ELSE '1' END || ordinal) AS first, arg_max(prefix, length(prefix)) AS longest FROM pages LEFT JOIN r ON starts_with(url, prefix) GROUP BY page_id")
def url_rules(spark, d):
    """The rule for each page's URL, out of as many rules as there are hosts, languages of hosts and addresses."""
    pages = table(spark, d, "pages").select("page_id", "url")
    parts = F.array(F.regexp_extract("url", "^https?://[^/]+/", 0), F.regexp_extract("url", "^https?://[^/]+/[a-z]{2}/", 0), F.split_part("url", F.lit("#"), F.lit(1)))
    named = pages.select(F.explode(parts).alias("prefix")).where("prefix != ''").distinct()
    return rules.match_prefixes(pages, "url", named.select("prefix", F.md5("prefix").alias("ordinal"), F.col("prefix").alias("rule"))).select("page_id", "first", "longest")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 480)")
def blacklist_anti(spark, d):
    e = table(spark, d, "events")
    banned = e.groupBy("user_id").agg(F.max("value").alias("m")).where("m > 480").select("user_id")
    return e.join(banned, "user_id", "left_anti").select("event_id")


NULLS = {"customer": ["c_custkey", "c_name", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderdate"]}


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS \"check\", count(*) - count({c}) AS failed, count(*) AS total FROM {t}" for t, cs in NULLS.items() for c in cs))
def null_checks(spark, d):
    out = None
    for t, cs in NULLS.items():
        part = quality.failing(table(spark, d, t), {f"{t}.{c}": F.col(c).isNull() for c in cs})
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT text AS value, count(*) AS rows FROM documents GROUP BY text HAVING count(*) > 1")
def uniqueness_check(spark, d):
    return quality.duplicates(table(spark, d, "documents"), "text")


@query(r"SELECT count(*) FILTER (NOT regexp_matches(lower(c_name) || '@mail' || c_nationkey || '.example', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')) AS failed, count(*) AS total FROM customer")
def email_check(spark, d):
    mail = F.concat(F.lower("c_name"), F.lit("@mail"), F.col("c_nationkey").cast("string"), F.lit(".example"))
    return table(spark, d, "customer").agg(F.count_if(~F.rlike(mail, F.lit(quality.EMAIL))).alias("failed"), F.count("*").alias("total"))


@query("SELECT 'negative' AS \"check\", count(*) FILTER (c_acctbal < 0) AS failed, count(*) AS total FROM customer UNION ALL SELECT 'large', count(*) FILTER (c_acctbal > 9000), count(*) FROM customer")
def range_checks(spark, d):
    return quality.failing(table(spark, d, "customer"), {"negative": F.col("c_acctbal") < 0, "large": F.col("c_acctbal") > 9000})


@query("SELECT count(*) FILTER (lang NOT IN ('en', 'de')) AS failed FROM documents")
def extension_check(spark, d):
    return table(spark, d, "documents").agg(F.count_if(~F.col("lang").isin("en", "de")).alias("failed"))


@query(
    """WITH c AS (SELECT 'customer' AS section, count(*) FILTER (c_name IS NULL) AS failed FROM customer UNION ALL SELECT 'customer', count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 'documents', count(*) FILTER (length(text) < 100 OR length(text) > 10000) FROM documents UNION ALL SELECT 'documents', count(*) FILTER (lang IS NULL) FROM documents),
s AS (SELECT section, count(*) FILTER (failed = 0) AS passed, count(*) AS checks FROM c GROUP BY section)
SELECT section, round(passed / checks * 100, 2) AS score, round((SELECT avg(passed / checks * 100) FROM s), 2) AS overall FROM s"""
)
def quality_scores(spark, d):
    c = quality.failing(table(spark, d, "customer"), {"name": F.col("c_name").isNull(), "balance": F.col("c_acctbal") < 0}).withColumn("section", F.lit("customer"))
    n = F.length("text")
    t = quality.failing(table(spark, d, "documents"), {"length": (n < 100) | (n > 10000), "lang": F.col("lang").isNull()}).withColumn("section", F.lit("documents"))
    s = quality.scores(c.unionByName(t))
    overall = s.agg(F.round(F.avg("score"), 2).alias("overall"))
    return s.select("section", F.round("score", 2).alias("score")).join(F.broadcast(overall))


LATEST = "(SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000)"


def _latest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10000)


def _pick(p, offset=1):
    return f"list_sort(list(value))[CAST(least(floor((count(*) - {offset}) * {p}), count(*) - 1) AS INTEGER) + 1]"


@query(
    f"SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev, {_pick(0.5)} AS p50, {_pick(0.9)} AS p90, {_pick(0.95)} AS p95, {_pick(0.99)} AS p99 FROM {LATEST}"
)
def latency_stats(spark, d):
    rows = _latest(spark, d)
    basic = rows.agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("stdev"))
    return ranks.floor_percentiles(rows, [], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).join(F.broadcast(basic))


@query(f"SELECT event_type, count(*) AS n, {_pick(0.5)} AS p50, {_pick(0.95)} AS p95 FROM {LATEST} GROUP BY event_type")
def latency_by_type(spark, d):
    return ranks.floor_percentiles(_latest(spark, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query(f"SELECT user_id, count(*) AS n, {_pick(0.95)} AS p95 FROM events GROUP BY user_id")
def p95_floor(spark, d):
    return ranks.floor_percentiles(table(spark, d, "events"), ["user_id"], "value", {"p95": 0.95})


@query(f"SELECT user_id, count(*) AS n, {_pick(0.95, 0)} AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100 GROUP BY user_id")
def p95_pool(spark, d):
    """Over each key's last 100 samples."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 100")
    return ranks.floor_percentiles(last, ["user_id"], "value", {"p95": 0.95}, offset=0)


@query("SELECT count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS recent, count(*) AS total FROM events")
def active_recent_counts(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("ts") >= F.col("now") - F.expr("interval 24 hours")).alias("recent"), F.count("*").alias("total"))


@query("SELECT event_type, user_id % 4 AS shard, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def counter_metrics(spark, d):
    e = table(spark, d, "events").withColumn("shard", F.col("user_id") % 4)
    return M.counters(e, ["event_type", "shard"], F.col("value")).withColumn("value", F.round("value", 4))


@query("SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def gauge_last(spark, d):
    return M.gauges(table(spark, d, "events"), ["event_type", "user_id"], "value", F.struct("ts", "event_id"))


HIST = "SELECT event_type, {b} AS bucket, count(*) FILTER ({c}) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type"
HIST_SQL = " UNION ALL ".join([HIST.format(b=f"'le_{b:g}'", c=f"value <= {b}") for b in M.LATENCY_BOUNDS] + [HIST.format(b="'le_inf'", c="value IS NOT NULL")])


@query(HIST_SQL)
def histogram_cumulative(spark, d):
    return M.histogram(table(spark, d, "events"), ["event_type"], "value").withColumn("sum", F.round("sum", 4))


@query(f"""SELECT 'latency_bucket{{event_type="' || event_type || '",le="' || CASE WHEN bucket = 'le_inf' THEN '+Inf' ELSE substr(bucket, 4) END || '"}} ' || count AS value FROM ({HIST_SQL})""")
def prometheus_text(spark, d):
    return M.exposition(M.histogram(table(spark, d, "events"), ["event_type"], "value"), "latency", "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70")
def hot_keys(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 70")


@query("SELECT event_type, round(count(*) FILTER (value < 50) / count(*), 4) AS rate FROM events GROUP BY event_type")
def hit_rate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count_if(F.col("value") < 50) / F.count("*"), 4).alias("rate"))


def _requests(spark, d):
    return table(spark, d, "events").withColumn("micros", E.micros(F.col("ts")))


DAY = 86400


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY * E.MICROS - 1} PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def sliding_count_redis(spark, d):
    return E.trailing_count(_requests(spark, d), ["user_id"], DAY, "n").select("event_id", (F.col("n") <= 3).alias("allowed"))


def fold_sql(first: str, state: str, nexts: str, answer: str) -> str:
    """A recursive walk over each key's rows in order; s is the state before a row, e the row."""
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, {first} FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, {nexts} FROM (SELECT *, {state} FROM r) s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id, {answer} FROM r"""


def _sliding_sql(cmp):
    kept = f"list_filter(s.ts, lambda x: x {cmp} e.t - {DAY * E.MICROS})"
    return fold_sql("[t] AS ts, true AS allowed", "1 AS one", f"CASE WHEN len({kept}) >= 3 THEN {kept} ELSE list_append({kept}, e.t) END, len({kept}) < 3", "allowed")


@query(_sliding_sql(">"))
def sliding_fold_gateway(spark, d):
    return E.ordered_fold(_requests(spark, d), "user_id", "micros", "event_id", E.sliding_window(3, DAY, False), [], "allowed", "boolean", gap=DAY).select("event_id", "allowed")


@query(_sliding_sql(">="))
def sliding_fold_middleware(spark, d):
    return E.ordered_fold(_requests(spark, d), "user_id", "micros", "event_id", E.sliding_window(3, DAY, True), [], "allowed", "boolean", gap=DAY).select("event_id", "allowed")


def _bucket_sql(capacity, per_day):
    now = f"least({capacity}::DOUBLE, s.tokens + (e.t - s.at) / 1000000.0::DOUBLE * ({per_day}.0::DOUBLE / {DAY}))"
    return fold_sql(f"({capacity} - 1)::DOUBLE AS tokens, t AS at, true AS allowed", "1 AS one", f"{now} - CASE WHEN {now} >= 1 THEN 1 ELSE 0 END, e.t, {now} >= 1", "allowed")


@query(_bucket_sql(6, 3))
def token_bucket_gateway(spark, d):
    return E.ordered_fold(_requests(spark, d), "user_id", "micros", "event_id", E.token_bucket(6.0, 3.0 / DAY), [], "allowed", "boolean", gap=2 * DAY).select("event_id", "allowed")


@query(_bucket_sql(3, 3))
def token_bucket(spark, d):
    return E.ordered_fold(_requests(spark, d), "user_id", "micros", "event_id", E.token_bucket(3.0, 3.0 / DAY), [], "allowed", "boolean", gap=DAY).select("event_id", "allowed")


@query(
    fold_sql(
        "t AS at, 1 AS n, true AS allowed",
        "1 AS one",
        f"CASE WHEN e.t - s.at >= {DAY * E.MICROS} THEN e.t ELSE s.at END, CASE WHEN e.t - s.at >= {DAY * E.MICROS} THEN 1 WHEN s.n < 2 THEN s.n + 1 ELSE s.n END, e.t - s.at >= {DAY * E.MICROS} OR s.n < 2",
        "allowed",
    )
)
def fixed_window(spark, d):
    return E.ordered_fold(_requests(spark, d), "user_id", "micros", "event_id", E.fixed_window(2, DAY), [], "allowed", "boolean", gap=DAY).select("event_id", "allowed")


_WAIT = f"{6 * 3600 * E.MICROS}"
_STATE = "s.state"
_REJ = f"(s.st = 'open' AND e.t - s.opened < {_WAIT})"
_HALF = f"(s.st = 'half_open' OR s.st = 'open')"


@query(
    fold_sql(
        "CASE WHEN ok THEN 'closed' ELSE 'closed' END AS st, CASE WHEN ok THEN 0 ELSE 1 END AS failed, 0 AS good, 0::BIGINT AS opened, 'closed' AS state",
        "1 AS one",
        f"""CASE WHEN {_REJ} THEN 'open' WHEN e.ok AND {_HALF} AND (CASE WHEN s.st = 'open' THEN 0 ELSE s.good END) + 1 >= 2 THEN 'closed' WHEN e.ok AND {_HALF} THEN 'half_open' WHEN e.ok THEN s.st WHEN {_HALF} OR s.failed + 1 >= 5 THEN 'open' ELSE s.st END,
CASE WHEN {_REJ} OR e.ok THEN s.failed ELSE s.failed + 1 END,
CASE WHEN {_REJ} THEN s.good WHEN {_HALF} THEN (CASE WHEN s.st = 'open' THEN 0 ELSE s.good END) + CASE WHEN e.ok THEN 1 ELSE 0 END ELSE s.good END,
CASE WHEN {_REJ} OR e.ok THEN s.opened WHEN {_HALF} OR s.failed + 1 >= 5 THEN e.t ELSE s.opened END,
CASE WHEN {_REJ} THEN 'rejected' WHEN e.ok AND {_HALF} AND (CASE WHEN s.st = 'open' THEN 0 ELSE s.good END) + 1 >= 2 THEN 'closed' WHEN e.ok AND {_HALF} THEN 'half_open' WHEN e.ok THEN s.st WHEN {_HALF} OR s.failed + 1 >= 5 THEN 'open' ELSE s.st END""",
        "state",
    )
)
def circuit_breaker(spark, d):
    rows = _requests(spark, d).withColumn("ok", F.col("event_type") != "error")
    return E.ordered_fold(rows, "user_id", "micros", "event_id", E.circuit_breaker(5, 6 * 3600, 2), ["ok"], "state", "string").select("event_id", "state")


def _alert_sql(keys, kind, seconds, least, where="true"):
    by = f"PARTITION BY {keys}" if keys else ""
    pick, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "HAVING count(*) > 0")
    return f"SELECT {pick}count(*) AS alerts, max(n) AS worst FROM (SELECT *, count(*) OVER ({by} ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * E.MICROS - 1} PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = '{kind}' AND {where}) WHERE n >= {least} {group}"


@query(_alert_sql("user_id", "error", DAY, 2))
def brute_force(spark, d):
    return E.threshold_alerts(_requests(spark, d).where("event_type = 'error'"), ["user_id"], DAY, 2)


@query(_alert_sql("user_id", "view", 3 * DAY, 4))
def suspicious_ip(spark, d):
    return E.threshold_alerts(_requests(spark, d).where("event_type = 'view'"), ["user_id"], 3 * DAY, 4)


@query(_alert_sql("user_id", "purchase", DAY, 2, "user_id <> 0"))
def anomalous_user(spark, d):
    return E.threshold_alerts(_requests(spark, d).where("event_type = 'purchase' and user_id != 0"), ["user_id"], DAY, 2)


@query("WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (ts >= now - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS last_day FROM events, m GROUP BY event_type")
def security_stats(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    since = lambda span: F.count_if(F.col("ts") >= F.col("now") - F.expr(f"interval {span}"))
    return e.join(F.broadcast(now)).groupBy("event_type").agg(F.count("*").alias("total"), since("1 hour").alias("last_hour"), since("24 hours").alias("last_day"))


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events")
def span_parent(spark, d):
    days = F.unix_date(F.col("ts").cast("date"))
    return E.previous(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], "event_id", "parent", days).select("event_id", "parent")


@query("SELECT event_type, round(avg(value), 6) AS mean, count(*) FILTER (value > 200) AS slow FROM events GROUP BY event_type")
def span_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 200).alias("slow"))


USAGE = """u AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS n_recent, max(ts) AS last FROM events GROUP BY user_id),
f AS (SELECT *, CASE WHEN n_recent = 0 THEN 'archive' WHEN n_recent < 2 THEN 'rare' WHEN n_recent < 10 THEN 'moderate' ELSE 'frequent' END AS frequency, ['hot', 'warm', 'cold', 'archive'][user_id % 4 + 1] AS tier, user_id * 10 AS size FROM u)"""


def _usage(spark, d):
    now = F.lit("2024-02-20").cast("timestamp_ntz")
    used = tiering.access_frequency(table(spark, d, "events"), "user_id", "ts", now)
    tiers = F.array(*[F.lit(t) for t in tiering.COST])
    return used.withColumn("tier", F.element_at(tiers, (F.col("user_id") % 4 + 1).cast("int"))).withColumn("size", F.col("user_id") * 10), now


@query(f"WITH {USAGE} SELECT user_id, n_recent, frequency FROM f")
def access_frequency(spark, d):
    return _usage(spark, d)[0].select("user_id", "n_recent", "frequency")


LATENCY_SQL = "CASE {} WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 5.0 WHEN 'cold' THEN 50.0 ELSE 200.0 END"
COST_SQL = "CASE {} WHEN 'hot' THEN 1.0 WHEN 'warm' THEN 0.5 WHEN 'cold' THEN 0.1 ELSE 0.05 END"


@query(
    f"""WITH {USAGE}, g AS (SELECT *, CASE frequency WHEN 'frequent' THEN 'hot' WHEN 'moderate' THEN 'warm' WHEN 'rare' THEN 'cold' ELSE 'archive' END AS target FROM f WHERE last < TIMESTAMP '2024-02-20' - INTERVAL 7 DAY)
SELECT user_id, tier, target, round((size * ({COST_SQL.format('tier')} - {COST_SQL.format('target')}))::DOUBLE, 6) AS saving FROM g WHERE target <> tier"""
)
def tier_plan(spark, d):
    used, now = _usage(spark, d)
    return tiering.plan(used, now).select("user_id", "tier", "target", F.round("saving", 6).alias("saving"))


@query(f"WITH {USAGE} SELECT tier, count(*) AS files, sum(size)::BIGINT AS size, round(sum(size * {COST_SQL.format('tier')})::DOUBLE, 6) AS cost FROM f GROUP BY tier")
def tier_stats(spark, d):
    used, _ = _usage(spark, d)
    return used.groupBy("tier").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.round(F.sum(F.col("size") * tiering.lookup(F.col("tier"), tiering.COST)), 6).alias("cost"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def order_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT 'customer' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def table_checksum(spark, d):
    """Rows of each table; table_contents adds the checksum of schema and contents."""
    counts = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t in ("customer", "orders")]
    return counts[0].unionByName(counts[1])


_CONTENTS = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
}


def _contents_sql(name, columns):
    row = "to_json({" + ", ".join(f"'{c}': {c}" for c in columns) + "})"
    part = lambda i: f"coalesce(sum(CAST('0x' || substr(h, {i}, 12) AS HUGEINT))::VARCHAR, '0')"
    schema = ",".join(f"{c}:{t}" for c, t in columns.items())
    return f"SELECT '{name}' AS table_name, count(*) AS rows, sha256('{schema}|' || count(*) || '|' || {part(1)} || '|' || {part(13)}) AS checksum FROM (SELECT sha256({row}::VARCHAR) AS h FROM {name})"


@query(" UNION ALL ".join(_contents_sql(*x) for x in _CONTENTS.items()))
def table_contents(spark, d):
    """Rows and checksum of the schema and of all rows, in any order, of each table."""
    sums = [R.content_checksum(table(spark, d, t)).withColumn("table_name", F.lit(t)) for t in _CONTENTS]
    return functools.reduce(lambda a, b: a.unionByName(b), sums)
