"""Answer queries: switched retrieval, contexts, replies, tools, and the entity graph of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as A
from ..operators import graph, reasoning, retrieval, routing, vectors
from ..sources.stored import kept
from ..sources.tables import table
from .documents import ENTITY_SQL, LATIN, PAIR_SQL, RRF_SQL, TITLE, bm25_sql, lexical, query_vector, vector_sql
from .named import collector

QUERIES, ORACLES, query = collector()


def _titled(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.title_of(F.col("text")).alias("title"), "text", "lang", "source")


def _sides(spark, d, k):
    v = table(spark, d, "embeddings")
    near = retrieval.nearest(v, query_vector(v), k, -1.0).withColumnRenamed("vec_id", "id")
    return near, lexical(spark, d).orderBy(F.desc("score"), "doc_id").limit(k).withColumnRenamed("doc_id", "id")


@query(f"SELECT 'both' AS mode, id, round(score, 6) AS score FROM ({RRF_SQL}) UNION ALL SELECT 'vector', vec_id, similarity FROM ({vector_sql(k=10)}) UNION ALL SELECT 'bm25', doc_id, score FROM ({bm25_sql(k=10)})")
def hybrid_modes(spark, d):
    """Both retrievers, each alone, and neither, which finds nothing."""
    near, lexical = _sides(spark, d, 20)
    out = None
    for mode, v, b in (("both", True, True), ("vector", True, False), ("bm25", False, True), ("none", False, False)):
        part = retrieval.hybrid(near, lexical, 10, v, b).select(F.lit(mode).alias("mode"), "id", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH h AS (SELECT id, row_number() OVER () AS k FROM ({RRF_SQL.replace('LIMIT 10', 'LIMIT 5')}))
SELECT coalesce(string_agg('[' || r || '] ' || {TITLE} || chr(10) || substr(text, 1, 300), chr(10) || chr(10) ORDER BY r), '无相关上下文') AS context FROM (SELECT text, row_number() OVER (ORDER BY k) AS r FROM h JOIN documents ON doc_id = id WHERE text IS NOT NULL)"""
)
def hybrid_context(spark, d):
    """The context of the five best by both retrievers; each side gives twice as many rows as a result of ten has."""
    best = retrieval.fuse(*_sides(spark, d, 20), 5)
    ranked = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: x["id"]).alias("ids")).select(F.posexplode("ids").alias("k", "doc_id"))
    hits = _titled(spark, d).join(F.broadcast(ranked), "doc_id")
    return hits.agg(routing.context_of(F.array_sort(F.collect_list(F.struct("k", "title", "text")))).alias("context"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    f"""SELECT CASE WHEN count(*) = 0 THEN '{A.NOT_FOUND}' ELSE '根据知识库找到 ' || count(*) || ' 条相关内容：' || chr(10) || chr(10) || string_agg(k || '. **' || {ESCAPED.format('title')} || '**' || chr(10) || {ESCAPED.format('substr(text, 1, 150)')} || CASE WHEN length(text) > 150 THEN '...' ELSE '' END || chr(10) || chr(10), '' ORDER BY k) END AS answer
FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, {TITLE} AS title, text FROM documents WHERE text ILIKE '%tion%' ORDER BY doc_id LIMIT 3)"""
)
def ask_reply(spark, d):
    best = _titled(spark, d).where(F.ilike("text", F.lit("%tion%"))).orderBy("doc_id").limit(3)
    return best.agg(A.reply(F.array_sort(F.collect_list(F.struct("doc_id", "title", "text")))).alias("answer"))


ASKED, GATES = ["what tion is", "the chkeit of mente", "nothing here", "re"], ("tion", "chkeit", "mente")


def _gate_sql(always=()):
    rules = []
    for q in ASKED:
        hold = [f"contains(lower(text), '{k}')" for k in (*[g for g in GATES if g in q], *always)]
        hold += [] if always else [f"contains(lower({TITLE}), '{q}')"]
        rules.append(f"SELECT '{q}' AS question, doc_id, {TITLE} AS title FROM documents WHERE text IS NOT NULL AND ({' OR '.join(hold)})")
    asked = "(SELECT unnest([" + ", ".join(f"'{q}'" for q in ASKED) + "]) AS question)"
    return f"SELECT question, count(doc_id) AS n, array_to_string(list_sort(list(doc_id) FILTER (doc_id IS NOT NULL))[1:3], ',') AS sources, arg_min(title, doc_id) AS best FROM {asked} LEFT JOIN ({' UNION ALL '.join(rules)}) USING (question) GROUP BY question"


@query(f"SELECT question, n, coalesce(sources, '') AS sources, best, CASE WHEN n = 0 THEN 0 ELSE round(least(0.9, 0.5 + n * 0.1), 2) END::DOUBLE AS confidence FROM ({_gate_sql()})")
def service_qa(spark, d):
    found = A.gated_answers(_titled(spark, d), ASKED, GATES)
    return found.select("question", "n", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"), "best", "confidence")


@query(f"SELECT question, n, coalesce(sources, '') AS sources, '搜索结果: 找到 ' || n || ' 篇相关文档' AS step3, CASE WHEN n > 0 THEN '生成答案: 基于 ' || best ELSE '生成答案: 使用通用回复' END AS step4 FROM ({_gate_sql(('ción',))})")
def service_reasoning(spark, d):
    found = A.reasoned_answers(_titled(spark, d), ASKED, GATES, ("ción",))
    return found.select("question", "n", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"), F.get("thoughts", F.lit(2)).alias("step3"), F.get("thoughts", F.lit(3)).alias("step4"))


DOMAIN_ASKED = [("motion", "tion", 3, 0.8, 0.2), ("herbs", "chkeit", 3, 0.8, 0.2), ("general", "zzzz", 5, 0.6, 0.1), ("all", "mente", 5, 0.6, 0.1)]


@query(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS domain, count(*) AS n, CASE WHEN count(*) > 0 THEN {y} ELSE {z} END::DOUBLE AS confidence, coalesce(string_agg(k || '. ' || title || chr(10) || '   ' || substr(text, 1, 150) || '...', chr(10) || chr(10) ORDER BY k), '') AS snippets
FROM (SELECT row_number() OVER (ORDER BY doc_id) AS k, {TITLE} AS title, text FROM documents WHERE text ILIKE '%{s}%' ORDER BY doc_id LIMIT {k})"""
        for n, s, k, y, z in DOMAIN_ASKED
    )
)
def domain_answers(spark, d):
    return A.domain_answers(_titled(spark, d), DOMAIN_ASKED)


@query(
    f"""WITH f AS (SELECT doc_id, contains(lower({TITLE}), 'e') AS t, contains(lower(lang), 'e')::INTEGER + contains(lower(source), 'e')::INTEGER AS n FROM documents WHERE text IS NOT NULL AND (contains(lower(text), 'e') OR contains(lower(lang), 'e') OR contains(lower(source), 'e')))
SELECT doc_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY t DESC, n DESC, doc_id LIMIT 25"""
)
def tag_search(spark, d):
    tagged = _titled(spark, d).withColumn("tags", F.array_compact(F.array("lang", "source")))
    return A.tag_search(tagged, "e", 25)


@query("SELECT r_name AS category, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def categories(spark, d):
    """A list of structs by group; the groups are small tables here, as a list is one row."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = nations.groupBy(F.col("r_name").alias("category")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    return lists.select("category", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["n_nationkey"].cast("string"), r["n_name"])), ",").alias("rows"))


_STEPS = "(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(
    f"""SELECT conv_id, CASE WHEN bool_or(k = n AND role = 'assistant' AND length(text) > 40) THEN max(text) FILTER (k = n)
ELSE '基于' || max(n) || '步推理，得出以下结论：' || chr(10) || chr(10) || coalesce(string_agg(k || '. ' || substr(text, 1, 100) || '...' || chr(10), '' ORDER BY k) FILTER (k <= 3 AND text <> ''), '') END AS answer FROM {_STEPS} GROUP BY conv_id"""
)
def final_answers(spark, d):
    """Each conversation's turns as steps."""
    c = table(spark, d, "conversations")
    step = F.struct(F.when(F.col("role") == "assistant", "finish").otherwise("search").alias("action"), F.when(F.length("text") > 40, F.col("text")).alias("observation"))
    whole = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by(step, "turn").alias("last"))
    first = A.first_rows(c, "conv_id", "turn").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("first"))
    return whole.join(first, "conv_id").select("conv_id", A.final_answer(F.col("first"), F.col("last"), F.col("n")).alias("answer"))


@query(
    f"""SELECT conv_id, coalesce(string_agg('- ' || role || ': ' || substr(text, 1, 100) || '...', chr(10) ORDER BY k) FILTER (k <= 3 AND contains(lower(text), 'th')), '未找到相关内容') AS found,
coalesce(arg_min(role || ': ' || substr(text, 1, 200), k) FILTER (contains(role, 'assis')), '未找到关于''assis''的知识') AS looked_up FROM {_STEPS} WHERE text IS NOT NULL GROUP BY conv_id"""
)
def react_tools(spark, d):
    c = table(spark, d, "conversations").where("text is not null")
    looked = c.groupBy("conv_id").agg(A.lookup_tool(F.col("role"), F.col("text"), F.col("turn"), "assis").alias("looked_up"))
    context = A.first_rows(c, "conv_id", "turn").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("title"), "text"))).alias("c"))
    return context.join(looked, "conv_id").select("conv_id", A.search_tool(F.col("c"), "th").alias("found"), "looked_up")


TEMPLATES = {"comparison": "Compare. {question}\n{context}", "reasoning": "Step by step: {question}\n{context}", "": "{question}\nContext: {context}"}


@query("SELECT conv_id, turn, CASE WHEN length(text) > 20 THEN 'Step by step: ' || text || chr(10) || role ELSE text || chr(10) || 'Context: ' || role END AS prompt FROM conversations WHERE text IS NOT NULL")
def prompts(spark, d):
    said = table(spark, d, "conversations").where("text is not null")
    return said.select("conv_id", "turn", A.prompt(F.col("text"), F.col("role"), T.question_type(F.col("text")), TEMPLATES).alias("prompt"))


@query(f"SELECT name, min(doc_id) AS first_doc FROM ({ENTITY_SQL}) GROUP BY name")
def entity_first_seen(spark, d):
    return graph.entities(table(spark, d, "documents"), LATIN).groupBy("name").agg(F.min("doc_id").alias("first_doc"))


@query(f"WITH p AS ({PAIR_SQL}) SELECT (SELECT count(*) FROM (SELECT x FROM p UNION SELECT y FROM p)) AS entities, (SELECT count(*) FROM p) AS relations")
def graph_export(spark, d):
    """What the graph of all documents holds; the edges themselves are cooccur_edges."""
    return graph.graph_counts(graph.cooccurrences(table(spark, d, "documents"), LATIN))


@query(f"WITH p AS ({PAIR_SQL}) SELECT d.lang, count(DISTINCT p.doc_id) AS docs, count(*) AS relations, round(least(least(0.4, 0.2 * 2) + least(0.05 * count(*), 0.4), 1.0), 2)::DOUBLE AS confidence FROM p JOIN documents d USING (doc_id) GROUP BY d.lang")
def graph_confidences(spark, d):
    """By language, for a question that names two entities of the graph."""
    docs = table(spark, d, "documents")
    edges = graph.cooccurrences(docs, LATIN).join(docs.select("doc_id", "lang"), "doc_id")
    per = edges.groupBy("lang").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("relations"))
    return per.select("lang", "docs", "relations", reasoning.graph_confidence(F.lit(2), F.col("relations")).alias("confidence"))


@query(
    f"WITH d AS (SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 50), e AS ({ENTITY_SQL.replace('FROM documents', 'FROM d')}), p AS ({PAIR_SQL.replace('FROM documents', 'FROM d').replace('JOIN documents d ON', 'JOIN d ON')}) "
    "SELECT count(*) AS entities, count(DISTINCT doc_id) AS docs, (SELECT count(*) FROM p) AS relations FROM e"
)
def graph_of_category(spark, d):
    """A graph for one question is built from the first 50 documents of its category: what it holds."""
    few = table(spark, d, "documents").where("lang = 'en'").orderBy("doc_id").limit(50)
    edges = graph.cooccurrences(few, LATIN).agg(F.count("*").alias("relations"))
    return graph.entities(few, LATIN).agg(F.count("*").alias("entities"), F.countDistinct("doc_id").alias("docs")).join(edges)


_MID = "WITH e AS (SELECT DISTINCT 's' || l_suppkey AS s, 'p' || l_partkey AS t, l_returnflag AS r FROM lineitem), m AS (SELECT min(t) AS p FROM (SELECT t FROM e WHERE s = 's5' INTERSECT SELECT t FROM e WHERE s = 's6'))"


def _relations(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("relation"))


@query(f"""{_MID} SELECT 0 AS step, 's5' AS "from", (SELECT min(r) FROM e WHERE s = 's5' AND t = p) AS relation, p AS "to" FROM m UNION ALL SELECT 1, p, NULL, 's6' FROM m""")
def graph_path_details(spark, d):
    edges = _relations(spark, d)
    path = graph.shortest_paths(edges, "s5", 2).where(F.col("name") == "s6").select("path")
    return graph.path_details(edges, path)


@query(
    f"""{_MID}, n AS (SELECT DISTINCT t FROM e WHERE s IN ('s5', 's6') ORDER BY t LIMIT 5)
SELECT 0 AS ordinal, '发现实体间路径: s5 → ' || p || ' → s6' AS text FROM m UNION ALL SELECT 1, '关系: s5 --[' || (SELECT min(r) FROM e WHERE s = 's5' AND t = p) || ']--> ' || p FROM m UNION ALL SELECT 3, '相关实体: ' || (SELECT string_agg(t, ', ' ORDER BY t) FROM n)"""
)
def graph_hop_steps(spark, d):
    return graph.hop_steps(_relations(spark, d), "s5", "s6", max_depth=2)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query, v.vec_id, list_cosine_similarity(q.e, v.e) AS similarity FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS k FROM s) WHERE k <= 10"""
)
def vector_search_set(spark, d):
    """The stated set of queries, every vec_id divisible by 50, against all rows."""
    v = table(spark, d, "embeddings")
    return vectors.nearest_of_each(v, v.where("vec_id % 50 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


def _count(words):
    return " + ".join(f"CAST(contains(text, '{w}') AS INTEGER)" for w in words)


@query(f"SELECT CASE WHEN ({_count(T.COMPARISON)}) > 0 THEN 'comparison' WHEN ({_count(T.EXPLANATION)}) > 0 THEN 'explanation' WHEN ({_count(T.MULTI_HOP)}) > 0 THEN 'multi_hop' WHEN length(text) > 20 THEN 'reasoning' ELSE 'factual' END AS kind, role, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def conversation_kinds(spark, d):
    return table(spark, d, "conversations").where("text is not null").groupBy(T.question_type(F.col("text")).alias("kind"), "role").agg(F.count("*").alias("n"))


@query(
    " UNION ALL ".join(f"SELECT domain, k, doc_id, confidence FROM (SELECT '{n}' AS domain, row_number() OVER (ORDER BY doc_id) AS k, doc_id, {y}::DOUBLE AS confidence FROM documents WHERE text ILIKE '%{s}%' ORDER BY doc_id LIMIT {k})" for n, s, k, y, _ in DOMAIN_ASKED)
)
def domain_results(spark, d):
    """The rows of several domains, one domain after another, the surest first."""
    return A.domain_rows(_titled(spark, d), DOMAIN_ASKED).select("domain", F.col("k").cast("long").alias("k"), "doc_id", "confidence")


def vector_index(spark, d) -> str:
    v = table(spark, d, "embeddings")
    return kept(v, "vectors", lambda folder: vectors.build(v, folder))


@query()
def vector_index_search(spark, d):
    """The stated query set against the index of all rows.

    The test tables' vectors don't cluster at all, so three lists of four are read, sixteen bytes a row, for a recall above
    0.9; 250 rows a query (an eighth at sf0.1) are then compared by their vectors.
    """
    v = table(spark, d, "embeddings")
    return vectors.search(v, vector_index(spark, d), v.where("vec_id % 50 = 0"), 10, share=0.75, shortlist=250).withColumn("similarity", F.round("similarity", 6))
