"""Request queries: masks, uploads, limits, replies of a model, scores, retention and made-up rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masking
from ..functions import requests as R
from ..functions import text as T
from ..operators import events as E
from ..operators import quality, reasoning, tiering
from ..sources import samples
from ..sources.tables import table
from .analytics import COST_SQL, LATENCY_SQL, USAGE, _requests, _usage
from .named import collector

QUERIES, ORACLES, query = collector()

DAY = 86400


def _digits(n: int):
    return F.lpad(F.col("c_custkey").cast("string"), n, "0")


@query(
    """SELECT c_custkey, '138****' || right(lpad(c_custkey::VARCHAR, 8, '0'), 4) AS phone, 'u' || repeat('*', length(c_custkey::VARCHAR) + 2) || right(c_custkey::VARCHAR, 1) || '@example.com' AS email,
'**** **** **** ' || right(lpad(c_custkey::VARCHAR, 15, '0'), 4) AS card_number, '***TOKEN***' AS access_token, c_mktsegment FROM customer"""
)
def mask_fields(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lit("138"), _digits(8)).alias("phone"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("4"), _digits(15)).alias("card_number"),
        F.concat(F.lit("t"), _digits(8)).alias("access_token"),
        "c_mktsegment",
    )
    return masking.mask_rows(rows)


@query("SELECT c_custkey, 'card ************' || right(lpad(c_custkey::VARCHAR, 12, '0'), 4) || ', twice ************' || right(lpad(c_custkey::VARCHAR, 12, '0'), 4) || '.' AS masked FROM customer")
def mask_cards(spark, d):
    card = F.concat(F.lit("4000"), _digits(12))
    parted = F.regexp_replace(card, "(.{4})(?=.)", "$1-")
    return table(spark, d, "customer").select("c_custkey", T.mask_cards(F.concat(F.lit("card "), card, F.lit(", twice "), parted, F.lit("."))).alias("masked"))


@query("""SELECT c_custkey, '{"user":{"phone":"138****' || right(lpad(c_custkey::VARCHAR, 8, '0'), 4) || '","city":"' || c_mktsegment || '"},"n":' || c_custkey || '}' AS masked FROM customer""")
def mask_json(spark, d):
    said = F.to_json(F.struct(F.struct(F.concat(F.lit("138"), _digits(8)).alias("phone"), F.col("c_mktsegment").alias("city")).alias("user"), F.col("c_custkey").alias("n")))
    return table(spark, d, "customer").select("c_custkey", masking.mask_json(said, "user struct<phone: string, city: string>, n bigint").alias("masked"))


@query("SELECT CASE user_id % 3 WHEN 0 THEN '10.0.0.' || user_id % 5 WHEN 1 THEN '10.1.0.' || user_id % 5 ELSE 'unknown' END AS client, count(*) AS n FROM events GROUP BY ALL")
def client_keys(spark, d):
    group, last = F.col("user_id") % 3, (F.col("user_id") % 5).cast("string")
    forwarded = F.when(group == 0, F.concat(F.lit(" 10.0.0."), last, F.lit(" , 10.9.9.9")))
    real = F.when(group == 1, F.concat(F.lit("10.1.0."), last))
    key = R.client_key(forwarded, real, F.lit(""))
    return table(spark, d, "events").groupBy(key.alias("client")).agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_replace(replace('..' || source || '/' || split_part(text, chr(10), 1), '/', '').replace(chr(92), ''), '[^A-Za-z0-9._\- \x{80}-\x{10FFFF}]', '_', 'g').ltrim('. ') AS name FROM documents WHERE text IS NOT NULL")
def safe_filenames(spark, d):
    name = F.concat(F.lit(".."), "source", F.lit("/"), T.title_of(F.col("text")))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", R.safe_filename(name).alias("name"))


@query(
    """SELECT CASE WHEN n_chars > 4096 THEN 'File size ' || printf('%.2f', n_chars / 1048576) || 'MB exceeds maximum 0.00MB' WHEN lang NOT IN ('de', 'en') THEN 'File extension ''.' || lang || ''' not allowed' ELSE 'Upload validation passed' END AS verdict, count(*) AS n
FROM documents GROUP BY ALL"""
)
def upload_verdicts(spark, d):
    verdict = R.upload_verdict(F.concat_ws(".", "source", "lang"), F.col("n_chars"), {".de", ".en"}, 4096)
    return table(spark, d, "documents").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN value < 100 THEN 'fast' WHEN value < 500 THEN 'normal' WHEN value < 1000 THEN 'slow' ELSE 'very_slow' END AS speed, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def log_classes(spark, d):
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 404).otherwise(200)
    return table(spark, d, "events").where("value IS NOT NULL").groupBy(R.speed_class(F.col("value")).alias("speed"), R.log_level(status).alias("level")).agg(F.count("*").alias("n"))


@query(
    f"""WITH n AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {DAY * E.MICROS - 1} PRECEDING AND CURRENT ROW) AS u,
count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN {DAY * E.MICROS - 1} PRECEDING AND CURRENT ROW) AS t FROM events)
SELECT event_id, u <= 3 AND t <= 1 AS allowed, CASE WHEN u > 3 THEN 'user' WHEN t > 1 THEN 'type' END AS denied_by, CASE WHEN u > 3 OR t > 1 THEN 0 ELSE least(3 - u, 1 - t) END AS remaining FROM n"""
)
def multi_limit(spark, d):
    kind = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    found = E.limits(_requests(spark, d), {"user": (F.col("user_id"), 3, DAY), "type": (kind, 1, DAY)})
    return found.select("event_id", "allowed", "denied_by", "remaining")


@query(
    """SELECT doc_id, 2 AS n_steps, '1. ' || lang || chr(10) || 'of ' || source AS first, '2. ' || doc_id AS last, trim(a, chr(9) || chr(10) || chr(13) || ' ') AS answer,
round(0.3 + least(length(trim(a, chr(9) || chr(10) || chr(13) || ' ')) / 500, 0.5), 2) AS confidence FROM (SELECT *, replace(text, chr(10), ' ') AS a FROM documents WHERE text IS NOT NULL)"""
)
def thought_steps(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    said = F.concat(F.lit("思考过程：\n1. "), "lang", F.lit("\nof "), "source", F.lit("\n2. "), F.col("doc_id").cast("string"), F.lit("\n答案："), F.replace("text", F.lit("\n"), F.lit(" ")))
    parsed = docs.select("doc_id", reasoning.thought_and_answer(said).alias("r")).select("doc_id", "r.*")
    return parsed.select(
        "doc_id",
        F.size("steps").alias("n_steps"),
        F.element_at("steps", 1).alias("first"),
        F.element_at("steps", -1).alias("last"),
        "answer",
        reasoning.thought_confidence(F.col("steps"), F.col("answer")).alias("confidence"),
    )


@query("SELECT conv_id, round(least(count(*) * 0.1::DOUBLE, 0.5) + least(count(*) FILTER (role = 'assistant') * 0.15::DOUBLE, 0.3), 2) AS confidence FROM conversations GROUP BY conv_id")
def action_scores(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("a"))
    return turns.select("conv_id", reasoning.action_confidence(F.col("n"), F.col("a")).alias("confidence"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(replace(replace(text, '.', '。'), 'tion', '要领'), '([^。！？]*[注意要领技巧][^。！？]*[。！？])')[1:5], '') AS tips FROM documents")
def practice_tips(spark, d):
    """The first five sentences with a tip; Latin sentence ends and an ending stand for the marks."""
    said = F.replace(F.replace("text", F.lit("."), F.lit("。")), F.lit("tion"), F.lit("要领"))
    return table(spark, d, "documents").select("doc_id", F.array_join(reasoning.practice_tips(said), "").alias("tips"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'unhealthy' WHEN bool_or(event_type = 'purchase') THEN 'degraded' WHEN bool_or(event_type = 'click') THEN 'healthy' ELSE 'unknown' END AS status FROM events GROUP BY user_id")
def health_worst(spark, d):
    status = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("event_type") == "purchase", "degraded").when(F.col("event_type") == "click", "healthy")
    return quality.worst_status(table(spark, d, "events").withColumn("status", status), ["user_id"], "status")


@query(
    """WITH n AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase' AND value > 200) AS p FROM events GROUP BY user_id),
p AS (SELECT user_id, (CASE e WHEN 0 THEN 40 WHEN 1 THEN 30 ELSE 0 END) + (CASE s WHEN 0 THEN 20 WHEN 1 THEN 15 WHEN 2 THEN 10 ELSE 5 END) + (CASE p WHEN 0 THEN 40 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 0 END) AS points FROM n)
SELECT user_id, points, CASE WHEN points >= 90 THEN 'A' WHEN points >= 80 THEN 'B' WHEN points >= 70 THEN 'C' WHEN points >= 60 THEN 'D' ELSE 'F' END AS grade FROM p"""
)
def security_grades(spark, d):
    kind = F.col("event_type")
    found = table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("e"), F.count_if(kind == "signup").alias("s"), F.count_if((kind == "purchase") & (F.col("value") > 200)).alias("p"))
    return found.select("user_id", quality.security_points(F.col("e"), F.col("s"), F.col("p")).alias("points")).withColumn("grade", quality.grade(F.col("points")))


@query(
    """WITH o AS (SELECT o_orderkey, floor((epoch(max(o_orderdate) OVER ()) - epoch(o_orderdate)) / 86400) AS age, count(*) OVER () AS total FROM orders)
SELECT CASE WHEN age > 365 THEN 'yearly' WHEN age > 30 THEN 'monthly' WHEN age > 7 THEN 'weekly' WHEN age > 1 THEN 'daily' END AS age_class, age > 1 AND total > CASE WHEN age > 365 THEN 3 WHEN age > 30 THEN 12 WHEN age > 7 THEN 4 ELSE 7 END AS expired, count(*) AS n FROM o GROUP BY ALL"""
)
def backup_retention(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dated = orders.join(orders.agg(F.max("o_orderdate").alias("now")))
    return tiering.retention(dated, "o_orderdate", F.col("now")).groupBy("age_class", "expired").agg(F.count("*").alias("n"))


@query(
    f"""WITH {USAGE}, g AS (SELECT *, CASE frequency WHEN 'frequent' THEN 'hot' WHEN 'moderate' THEN 'warm' WHEN 'rare' THEN 'cold' ELSE 'archive' END AS target FROM f WHERE last < TIMESTAMP '2024-02-20' - INTERVAL 7 DAY)
SELECT tier, target, count(*) AS moves, sum(size)::BIGINT AS size, round(sum(size * ({COST_SQL.format('tier')} - {COST_SQL.format('target')}))::DOUBLE, 6) AS saving FROM g WHERE target <> tier GROUP BY ALL"""
)
def tier_savings(spark, d):
    return tiering.savings(tiering.plan(*_usage(spark, d)))


@query(
    f"""WITH {USAGE}, g AS (SELECT *, CASE frequency WHEN 'frequent' THEN 'hot' WHEN 'moderate' THEN 'warm' WHEN 'rare' THEN 'cold' ELSE 'archive' END AS target FROM f WHERE last < TIMESTAMP '2024-02-20' - INTERVAL 7 DAY),
m AS (SELECT user_id, round((size * ({COST_SQL.format('tier')} - {COST_SQL.format('target')}))::DOUBLE, 6) AS saving, {LATENCY_SQL.format('tier')} - {LATENCY_SQL.format('target')} AS latency_gain FROM g WHERE target <> tier),
r AS (SELECT *, row_number() OVER (ORDER BY saving DESC, user_id) AS rank FROM m)
SELECT user_id, saving, latency_gain::DOUBLE AS latency_gain, rank, ((rank - 1) // 50 + 1)::INTEGER AS batch FROM r WHERE rank <= 1000"""
)
def tier_batches(spark, d):
    """The moves of one run: the thousand that save most, in batches of fifty."""
    moves = tiering.batches(tiering.plan(*_usage(spark, d)), "user_id")
    return moves.select("user_id", F.round("saving", 6).alias("saving"), "latency_gain", "rank", "batch")


@query("SELECT 'import_user_' || c_custkey AS username, 'import_user_' || c_custkey || '@example.com' AS email, 'Import User ' || c_custkey AS full_name, true AS is_active, false AS is_admin FROM customer")
def sample_users(spark, d):
    """A user for each stored customer."""
    return samples.users_of(table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT user_id, 'query ' || event_id AS query, 'keyword' AS search_type, event_id % 50 AS results_count, (event_id % 1000 + 50)::DOUBLE AS response_time_ms FROM events")
def sample_searches(spark, d):
    """A search for each stored event, by the event's user."""
    return samples.searches_of(table(spark, d, "events"), "event_id", "user_id")
