"""Document queries: listing, search, counts, retrieval, routing and text preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import communities, graph, mentions, postings, retrieval, routing, trigrams
from ..sources.stored import kept, stored
from ..sources.tables import file_category, new_titles, table
from .named import collector

QUERIES, ORACLES, query = collector()

TOKENS = r"list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: length(x) > 1)"
TITLE = "split_part(text, chr(10), 1)"


@query("SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 20 OFFSET 20")
def doc_list_page(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").orderBy("doc_id").offset(20).limit(20)


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id = 7")
def doc_by_id(spark, d):
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "text", "lang")


@query(rf"SELECT doc_id, {TITLE} AS title FROM documents WHERE lang = 'en' AND ({TITLE} ILIKE '%th_re%' OR text ILIKE '%th_re%') ORDER BY doc_id LIMIT 50")
def doc_ilike_search(spark, d):
    docs = table(spark, d, "documents").withColumn("title", T.title_of(F.col("text")))
    found = docs.where((F.col("lang") == "en") & (F.ilike("title", F.lit("%th_re%")) | F.ilike("text", F.lit("%th_re%"))))
    return found.orderBy("doc_id").limit(50).select("doc_id", "title")


def trigram_index(spark, d) -> str:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return kept(docs, "trigrams", lambda folder: trigrams.build(docs, folder))


ILIKES = ["%th_re%", "%NTHETI%", "%der%on%le%", "%ción%", "thinon%", "%_e%", "%zq%xj%k%"]


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS docs, min(doc_id) AS first_doc, CAST(sum(length(text)) AS BIGINT) AS size FROM documents WHERE text ILIKE '{p}'" for p in ILIKES))
def ilike_patterns(spark, d):
    """Patterns with both wildcards over all texts; where a pattern has three letters in a row, the index says which texts are read."""
    docs, path, out = table(spark, d, "documents").select("doc_id", "text"), trigram_index(spark, d), None
    for p in ILIKES:
        part = trigrams.ilike(docs, path, p).agg(F.lit(p).alias("pattern"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.sum(F.length("text")).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


@query(rf"SELECT doc_id, {TITLE} AS title FROM documents WHERE {TITLE} ILIKE '%der%' ORDER BY doc_id LIMIT 1")
def doc_title_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.title_of(F.col("text")).alias("title"))
    return docs.where(F.ilike("title", F.lit("%der%"))).orderBy("doc_id").limit(1)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def doc_category_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY ROLLUP (lang)")
def doc_stats(spark, d):
    return table(spark, d, "documents").rollup("lang").agg(F.count("*").alias("n"))


@query("SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS summary FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def doc_category_map(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", "n"))), ",").alias("summary"))


@query("SELECT coalesce(round(count(embedding) / nullif(count(*), 0) * 100, 2), 0) AS coverage FROM embeddings")
def embed_coverage(spark, d):
    return table(spark, d, "embeddings").agg(F.coalesce(F.round(F.count("embedding") / F.nullif(F.count("*"), F.lit(0)) * 100, 2), F.lit(0.0)).alias("coverage"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark, d):
    return postings.term_frequencies(table(spark, d, "documents"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    return retrieval.document_frequencies(table(spark, d, "documents"))


def bm25_sql(where: str = "true", k: int = 10) -> str:
    return rf"""
WITH t AS (SELECT doc_id, lang, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
q AS (SELECT unnest(['the', 'hation', 'thtion', 'the', 'thing']) AS term),
f AS (SELECT doc_id, lang, len(ts) AS dl, q.term, len(list_filter(ts, lambda x: x = q.term)) AS tf FROM t, q),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM f WHERE tf > 0 GROUP BY term)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM f JOIN df USING (term), s WHERE tf > 0 AND {where} GROUP BY doc_id ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) DESC, doc_id LIMIT {k}"""


BM25_QUERY = ["the", "hation", "thtion", "the", "thing"]


def lexical_index(spark, d) -> str:
    """The folder of the documents' lexical index, which the first query over these files builds."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return kept(docs, "postings", lambda folder: postings.build(docs, folder))


def lexical(spark, d):
    """doc_id, score of the documents that hold a term of the query."""
    return postings.scored(spark, lexical_index(spark, d), " ".join(BM25_QUERY))


def _top(df, k):
    return df.orderBy(F.desc("score"), "doc_id").limit(k).withColumn("score", F.round("score", 6))


@query(bm25_sql())
def bm25_topk(spark, d):
    return _top(lexical(spark, d), 10)


@query(bm25_sql("lang = 'en'"))
def bm25_topk_category(spark, d):
    """Corpus statistics are those of all documents."""
    return _top(lexical(spark, d).join(table(spark, d, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), 10)


@query(
    rf"""WITH t AS (SELECT doc_id, {TOKENS} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) GROUP BY ALL), w AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
x AS (SELECT item_id, doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x) WHERE rank <= 10"""
)
def bm25_query_set(spark, d):
    """The ten best documents for each benchmark text, from the blocks of the index whose bounds reach them."""
    found, _ = postings.search(spark, lexical_index(spark, d), table(spark, d, "benchmark").select("item_id", "text"), 10, "item_id")
    return found.select(F.col("query").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))


@query(
    """WITH r AS (SELECT doc_id, list_transform(range(0, 32), lambda i: (CAST('0x' || substr(sha256(text), 2 * i + 1, 2) AS INTEGER) / 255.0::DOUBLE - 0.5) * 2) AS v FROM documents)
SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS d0, round(v[2] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS d1, round(v[32] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS d31 FROM r"""
)
def hash_embedding(spark, d):
    e = table(spark, d, "documents").select("doc_id", T.hash_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", *[F.round(F.col("e")[i], 6).alias(f"d{i}") for i in (0, 1, 31)])


def query_vector(vectors) -> list[float]:
    return [float(x) for x in vectors.where("vec_id = 0").select("embedding").first()[0]]


def vector_sql(where: str = "true", k: int = 10, after: str = "true") -> str:
    return f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS similarity FROM embeddings, q WHERE embedding IS NOT NULL AND {where} ORDER BY similarity DESC, vec_id LIMIT {k})
SELECT vec_id, round(similarity, 6) AS similarity FROM s WHERE {after}"""


@query(vector_sql())
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v, query_vector(v), 10, -1.0).withColumn("similarity", F.round("similarity", 6))


@query(vector_sql("label = 3"))
def vector_topk_label(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v.where("label = 3"), query_vector(v), 10, -1.0).withColumn("similarity", F.round("similarity", 6))


@query(vector_sql(k=400, after="similarity >= 0.0"))
def vector_threshold_after_limit(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.nearest(v, query_vector(v), 400, 0.0).withColumn("similarity", F.round("similarity", 6))


RRF_SQL = f"""WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) - 1 AS rv FROM ({vector_sql(k=20).replace('round(similarity, 6) AS similarity', 'similarity')})),
b AS (SELECT doc_id AS id, row_number() OVER () - 1 AS rb FROM ({bm25_sql(k=20)}))
SELECT coalesce(v.id, b.id) AS id, round(coalesce(0.6 / (60 + rv), 0) + coalesce(0.4 / (60 + rb), 0), 9) AS score FROM v FULL OUTER JOIN b ON v.id = b.id ORDER BY coalesce(0.6 / (60 + rv), 0) + coalesce(0.4 / (60 + rb), 0) DESC, 1 LIMIT 10"""


@query(RRF_SQL)
def rrf_hybrid(spark, d):
    """Vectors and documents share the id space here; each side gives twice as many rows as the result has."""
    v = table(spark, d, "embeddings")
    near = retrieval.nearest(v, query_vector(v), 20, -1.0).withColumnRenamed("vec_id", "id")
    found = lexical(spark, d).orderBy(F.desc("score"), "doc_id").limit(20).withColumnRenamed("doc_id", "id")
    return retrieval.fuse(near, found, 10).select("id", F.round("score", 9).alias("score"))


@query(f"WITH b AS ({bm25_sql(k=50)}), e AS (SELECT min(score) AS lo, max(score) AS hi FROM b) SELECT doc_id, round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 4) AS normalised FROM b, e")
def score_minmax(spark, d):
    best = _top(lexical(spark, d), 50)
    return retrieval.min_max(best, "score").select("doc_id", F.round("normalised", 4).alias("normalised"))


@query(
    f"""SELECT coalesce(string_agg('[' || k || '] ' || title || chr(10) || substr(text, 1, 300), chr(10) || chr(10) ORDER BY k), '无相关上下文') AS context
FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, {TITLE} AS title, text FROM documents WHERE text ILIKE '%there%' ORDER BY doc_id LIMIT 5)"""
)
def context_format(spark, d):
    best = table(spark, d, "documents").where(F.ilike("text", F.lit("%there%"))).orderBy("doc_id").limit(5)
    return best.agg(routing.context_of(F.array_sort(F.collect_list(F.struct("doc_id", T.title_of(F.col("text")).alias("title"), "text")))).alias("context"))


@query(
    f"""SELECT doc_id, {TITLE} AS title, replace(replace(replace(replace(replace(substr(text, 1, 150), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || CASE WHEN length(text) > 150 THEN '...' ELSE '' END AS snippet
FROM documents WHERE text ILIKE '%tion%' ORDER BY doc_id LIMIT 3"""
)
def ask_answer(spark, d):
    best = table(spark, d, "documents").where(F.ilike("text", F.lit("%tion%"))).orderBy("doc_id").limit(3)
    return best.select("doc_id", T.title_of(F.col("text")).alias("title"), routing.snippet(F.col("text")).alias("snippet"))


# Latin keyword table for the driver's texts, in the form of the default one.
DOMAINS = [("motion", 10, ["tion", "ingre", "hati"], ["edst"]), ("herbs", 9, ["chkeit", "lich"], ["pf"]), ("letters", 8, ["ción", "mente"], ["ue"])]


def _score_sql(name, priority, keywords, categories):
    hits = " + ".join([f"0.3 * CAST(contains(lower(text), '{w}') AS INTEGER)" for w in keywords] + [f"0.2 * CAST(contains(lower(text), '{c}') AS INTEGER)" for c in categories])
    return f"SELECT item_id, '{name}' AS domain, {priority} AS priority, round(least(1.0, {hits}), 6)::DOUBLE AS score FROM benchmark"


SCORES_SQL = " UNION ALL ".join(_score_sql(*x) for x in DOMAINS)


@query(f"SELECT item_id, domain, score FROM ({SCORES_SQL})")
def domain_scores(spark, d):
    return routing.domain_scores(table(spark, d, "benchmark"), DOMAINS, "item_id").select("item_id", "domain", F.round("score", 6).alias("score"))


@query(f"SELECT item_id, coalesce(max(CASE WHEN k = 1 AND score > 0 THEN domain END), 'general') AS domain FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, priority DESC) AS k FROM ({SCORES_SQL})) GROUP BY item_id")
def domain_route(spark, d):
    return routing.route(table(spark, d, "benchmark"), DOMAINS, "item_id")


@query(f"SELECT item_id, domain, score FROM ({SCORES_SQL}) WHERE score > 0.3")
def domain_fan_out(spark, d):
    return routing.domain_scores(table(spark, d, "benchmark"), DOMAINS, "item_id").where("score > 0.3").select("item_id", "domain", F.round("score", 6).alias("score"))


QUESTIONS = ["八段锦第一式怎么做？", "中医怎么把脉？", "孔子的仁政思想是什么？", "今天天气怎么样", "气功和中医的区别", "为什么", "解释原理", "abcdefghijklmnopqrstuvwxyz", "关系", "如何", "步骤如何说明", "cat"]
QUESTION_ROWS = "(SELECT item_id, [" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][item_id % {len(QUESTIONS)} + 1] || substr(text, 1, item_id % 30) AS text FROM benchmark)"


def _questions(spark, d):
    """A question for each benchmark text, which it goes on with."""
    asked = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("item_id") % len(QUESTIONS) + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(asked, F.substring("text", F.lit(1), (F.col("item_id") % 30).cast("int"))).alias("text"))


def _count_sql(words):
    return " + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in words)


@query(
    f"""SELECT item_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'qigong' WHEN b >= c THEN 'tcm' ELSE 'confucian' END AS domain
FROM (SELECT item_id, {_count_sql(routing.GATEWAY['qigong'])} AS a, {_count_sql(routing.GATEWAY['tcm'])} AS b, {_count_sql(routing.GATEWAY['confucian'])} AS c FROM {QUESTION_ROWS})"""
)
def gateway_detect(spark, d):
    return _questions(spark, d).select("item_id", routing.gateway_domain(F.col("text")).alias("domain"))


@query(f"SELECT item_id, CASE WHEN ({_count_sql(T.COMPARISON)}) > 0 THEN 'comparison' WHEN ({_count_sql(T.EXPLANATION)}) > 0 THEN 'explanation' WHEN ({_count_sql(T.MULTI_HOP)}) > 0 THEN 'multi_hop' WHEN length(text) > 20 THEN 'reasoning' ELSE 'factual' END AS kind FROM {QUESTION_ROWS}")
def question_type(spark, d):
    return _questions(spark, d).select("item_id", T.question_type(F.col("text")).alias("kind"))


@query(f"SELECT item_id, CASE WHEN contains(text, '关系') OR contains(text, '区别') THEN 'graph_rag' WHEN contains(text, '如何') OR contains(text, '步骤') THEN 'react' ELSE 'cot' END AS mode FROM {QUESTION_ROWS}")
def reason_mode(spark, d):
    return _questions(spark, d).select("item_id", T.reason_mode(F.col("text")).alias("mode"))


# Entity patterns for the driver's texts, in the form of the default ones.
LATIN = {"a": "(thtion|hation|ndble)", "b": "(chkeit|lichei)", "c": "(ciónmi|mentera)"}
ENTITY_SQL = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS name FROM documents" for t, p in LATIN.items())
PAIR_SQL = f"""WITH e AS ({ENTITY_SQL}) SELECT a.doc_id, a.name AS x, b.name AS y FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.name < b.name JOIN documents d ON d.doc_id = a.doc_id
WHERE regexp_matches(d.text, a.name || '.{{0,50}}' || b.name) OR regexp_matches(d.text, b.name || '.{{0,50}}' || a.name)"""


@query(f"SELECT doc_id, name, type FROM ({ENTITY_SQL})")
def entity_extract(spark, d):
    return graph.entities(table(spark, d, "documents"), LATIN).select("doc_id", "name", "type")


@query(f"SELECT name, type, count(*) AS docs FROM ({ENTITY_SQL}) GROUP BY name, type")
def entity_counts(spark, d):
    return graph.entities(table(spark, d, "documents"), LATIN).groupBy("name", "type").agg(F.count("*").alias("docs"))


@query(PAIR_SQL)
def cooccur_edges(spark, d):
    return graph.cooccurrences(table(spark, d, "documents"), LATIN).select("doc_id", F.least("source", "target").alias("x"), F.greatest("source", "target").alias("y"))


_LINKS = f"WITH RECURSIVE p AS (SELECT DISTINCT x, y FROM ({PAIR_SQL})), u AS (SELECT x AS s, y AS t FROM p UNION SELECT y, x FROM p)"


def _edges(spark, d):
    return graph.cooccurrences(table(spark, d, "documents"), LATIN)


@query(f"{_LINKS} SELECT DISTINCT t AS name FROM u WHERE s = 'hation'")
def graph_neighbors(spark, d):
    return graph.neighbours(_edges(spark, d), "hation")


@query(f"{_LINKS}, w AS (SELECT DISTINCT s AS v, 0 AS hops FROM u WHERE s = 'hation' UNION SELECT t, hops + 1 FROM w JOIN u ON s = v WHERE hops < 3) SELECT v AS name, min(hops) AS hops FROM w GROUP BY v")
def graph_path(spark, d):
    return graph.shortest_paths(_edges(spark, d), "hation", 3).select("name", "hops")


@query(f"{_LINKS}, n AS (SELECT t AS v FROM u WHERE s IN ('hation', 'chkeit') UNION SELECT s FROM u WHERE s IN ('hation', 'chkeit')) SELECT x, y FROM p WHERE x IN (SELECT v FROM n) AND y IN (SELECT v FROM n)")
def graph_subgraph(spark, d):
    edges = _edges(spark, d).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return graph.subgraph(edges, ["hation", "chkeit"]).select(F.col("source").alias("x"), F.col("target").alias("y"))


@query(
    f"""{_LINKS}, q AS (SELECT DISTINCT item_id, v FROM (SELECT item_id, unnest({[n for p in LATIN.values() for n in p.strip('()').split('|')]}) AS v, text FROM benchmark) WHERE contains(text, v)),
n AS (SELECT DISTINCT item_id, unnest([s, t]) AS v FROM q JOIN u ON q.v = u.s)
SELECT a.item_id, x, y FROM p JOIN n a ON a.v = x JOIN n b ON b.v = y AND a.item_id = b.item_id"""
)
def graph_of_questions(spark, d):
    """For each benchmark item as a question: the edges between the entities it names and their neighbours, in the graph of all documents."""
    asked = graph.entities(table(spark, d, "benchmark"), LATIN, "item_id").select("item_id", "name")
    edges = stored(_edges(spark, d).select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct(), "edges")
    return graph.subgraphs(edges, asked, "item_id").select("item_id", F.col("source").alias("x"), F.col("target").alias("y"))


@query(
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}]{6,}')) AS name FROM benchmark)
SELECT name, count(*) AS docs, min(doc_id) AS first_doc FROM documents JOIN w ON contains(text, name) GROUP BY name"""
)
def dictionary_docs(spark, d):
    """Each word of six letters or more of the benchmark, as a dictionary of names: how many documents hold it, inside of words too."""
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{6,}"), F.lit(0)))
    names = [r.name for r in table(spark, d, "benchmark").select(words.alias("name")).distinct().limit(mentions.MOST + 1).collect()]
    return mentions.contained(table(spark, d, "documents"), names).groupBy("name").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


def _rounds_sql(n):
    """Label propagation in n rounds, each as tables of their own."""
    out = """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem), k AS (SELECT source AS a, target AS b, 1 AS w FROM e UNION ALL SELECT target, source, 1 FROM e),
c0 AS (SELECT DISTINCT a AS name, a AS community FROM k)"""
    for i in range(n):
        out += f""",
v{i} AS (SELECT a, label, sum(w) AS w FROM (SELECT k.a, c.community AS label, w FROM k JOIN c{i} c ON k.b = c.name UNION ALL SELECT name, community, 1 FROM c{i}) GROUP BY a, label),
b{i} AS (SELECT a, min(label) AS label FROM (SELECT *, max(w) OVER (PARTITION BY a) AS most FROM v{i}) WHERE w = most GROUP BY a),
c{i + 1} AS (SELECT name, CASE WHEN label {'<' if i % 2 == 0 else '>'} community THEN label ELSE community END AS community FROM c{i} JOIN b{i} ON name = a)"""
    return f"{out} SELECT name, community FROM c{n}"


@query(_rounds_sql(4))
def graph_communities(spark, d):
    """Which suppliers and parts hang together, over all of lineitem."""
    return communities.communities(_supplies(spark, d), 4)


def _supplies(spark, d):
    """An edge for each supplier and part that any row of lineitem has."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))


@query("SELECT DISTINCT 'p' || l_partkey AS name FROM lineitem WHERE l_suppkey = 5")
def graph_neighbors_whole(spark, d):
    return graph.neighbours(_supplies(spark, d), "s5")


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), p1 AS (SELECT p FROM e WHERE s = 5), s2 AS (SELECT DISTINCT s FROM e WHERE p IN (SELECT p FROM p1) AND s <> 5)
SELECT DISTINCT 's5' AS name, 0 AS hops FROM p1 UNION ALL SELECT 'p' || p, 1 FROM p1 UNION ALL SELECT 's' || s, 2 FROM s2 UNION ALL SELECT DISTINCT 'p' || p, 3 FROM e WHERE s IN (SELECT s FROM s2) AND p NOT IN (SELECT p FROM p1)"""
)
def graph_path_whole(spark, d):
    return graph.shortest_paths(_supplies(spark, d), "s5", 3).select("name", "hops")


@query("SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE l_suppkey IN (5, 6)")
def graph_subgraph_whole(spark, d):
    return graph.subgraph(_supplies(spark, d), ["s5", "s6"])


CLEAN_SQL = r"""SELECT doc_id, array_to_string(list_filter(ls, lambda x, i: NOT list_contains(list_slice(ls, 1, i - 1), x)), chr(10)) AS cleaned FROM (
SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), '\t+', ' ', 'g'), '\n\s*\d+\s*\n', chr(10), 'g'), '\n\s*第\s*\d+\s*页\s*\n', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> '') AS ls FROM documents)"""


@query(CLEAN_SQL)
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def _chunk_sql(size, step, least):
    return f"SELECT doc_id, p AS position, substr(text, p + 1, {size}) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {step}))::INTEGER AS p FROM documents) WHERE length(substr(text, p + 1, {size})) > {least}"


@query(_chunk_sql(512, 462, 50))
def chunk_512_50(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(T.chunks(F.col("text"))))


@query(_chunk_sql(512, 512, 0))
def chunk_plain(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(T.chunks(F.col("text"), 512, 0, None)))


REDACT_SQL = "lower(text)"
for _w in T.SENSITIVE_WORDS:
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, '{_w}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, {REDACT_SQL} AS message FROM documents")
def redact_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("message"))


def _masked_sql(text, masks):
    for pattern, new in masks:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), new.replace("$", chr(92)))
    return text


def _each_match_sql(column, pattern, masked):
    """column with each match m of the pattern replaced by `masked`, in DuckDB."""
    parts = f"list_zip(string_split_regex({column}, '{pattern}'), regexp_extract_all({column}, '{pattern}'))"
    return f"array_to_string(list_transform({parts}, lambda z: z[1] || coalesce(list_transform([z[2]], lambda m: {masked})[1], '')), '')"


_LOCAL = "split_part(m, '@', 1)"
_MAIL = f"CASE WHEN length({_LOCAL}) <= 2 THEN repeat('*', length({_LOCAL})) ELSE {_LOCAL}[1] || repeat('*', length({_LOCAL}) - 2) || {_LOCAL}[-1] END || '@' || split_part(m, '@', -1)"
_CARD = r"repeat('*', length(regexp_replace(m, '[\s-]', '', 'g')) - 4) || right(regexp_replace(m, '[\s-]', '', 'g'), 4)"


def email_sql(column):
    return _each_match_sql(column, T.EMAIL, _MAIL)


SENSITIVE_SQL = f"SELECT doc_id, {_masked_sql('text', T.MASKS)} AS t FROM documents"
for _p, _m in [(T.EMAIL, _MAIL), *[(c, _CARD) for c in T.CARDS]]:
    SENSITIVE_SQL = f"SELECT doc_id, {_each_match_sql('t', _p, _m)} AS t FROM ({SENSITIVE_SQL})"


@query(f"SELECT doc_id, {_masked_sql('text', T.MASKS)} AS masked FROM documents")
def mask_backref(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mask_contents(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, {_masked_sql('t', T.PASSWORDS)} AS masked FROM ({SENSITIVE_SQL})")
def mask_sensitive(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mask_sensitive(F.col("text")).alias("masked"))


@query(
    """WITH t AS (SELECT split_part(text, chr(10), 1) AS title FROM documents), e AS (SELECT DISTINCT split_part(text, chr(10), 1) AS title FROM benchmark WHERE text IS NOT NULL)
SELECT DISTINCT title FROM t WHERE title IS NOT NULL AND title NOT IN (SELECT title FROM e)"""
)
def import_dedup_title(spark, d):
    """All documents come in; the titles there are those of the benchmark."""
    title = T.title_of(F.col("text")).alias("title")
    return new_titles(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", title), table(spark, d, "benchmark").select(title)).select("title")


@query("SELECT page_id, CASE WHEN contains(lower(url), '气功') OR contains(lower(url), 'qigong') THEN '气功' WHEN contains(lower(url), 'tcm') OR contains(lower(url), '中医') THEN '中医' WHEN contains(lower(url), '儒家') OR contains(lower(url), 'confucian') THEN '儒家' ELSE '气功' END AS category FROM pages")
def filename_category(spark, d):
    return table(spark, d, "pages").select("page_id", file_category(F.col("url")).alias("category"))


@query(r"SELECT lower(regexp_extract(url, '\.([A-Za-z]{2,4})(?:[?#].*)?$', 1)) AS extension, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def file_type_distribution(spark, d):
    pages = table(spark, d, "pages").withColumn("extension", F.lower(F.regexp_extract("url", r"\.([A-Za-z]{2,4})(?:[?#].*)?$", 1)))
    return pages.groupBy("extension").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("size"))


@query(
    r"""WITH r AS (SELECT conv_id, turn, 'Thought: ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Action: search' || chr(10) || 'Action Input: ' || length(text) ELSE '' END AS reply FROM conversations)
SELECT conv_id, turn, trim(regexp_extract(reply, '(?i)Thought:\s*([^\n]*)', 1)) AS thought, coalesce(nullif(trim(regexp_extract(reply, '(?i)Action:\s*([^\n]*)', 1)), ''), 'finish') AS action, trim(regexp_extract(reply, '(?i)Action Input:\s*([^\n]*)', 1)) AS input FROM r"""
)
def react_parse(spark, d):
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Action: search\nAction Input: "), F.length("text").cast("string"))).otherwise("")
    replies = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Thought: "), "role", F.lit("\n"), tail).alias("reply"))
    return replies.select("conv_id", "turn", T.react_fields(F.col("reply")).alias("f")).select("conv_id", "turn", "f.*")
