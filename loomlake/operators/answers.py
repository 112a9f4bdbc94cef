"""Answers made from retrieved rows: replies, keyword-gated answers, domain answers, tag search, prompts and tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .routing import snippet

# Phrases of the replies.
FOUND = "根据知识库找到 %d 条相关内容：\n\n"
NOT_FOUND = "抱歉，知识库中没有找到相关内容。请尝试其他关键词，如：气功、八段锦、中医、论语等。"
# Keywords that let a question select documents by content, and those of the answer with reasoning.
GATE_KEYWORDS = ("气功", "高血压", "练习", "呼吸", "八段锦", "太极拳")
REASON_KEYWORDS = ("气功", "高血压", "练习", "方法", "原理")


def _holds(text: Column, word: str) -> Column:
    return F.contains(F.lower(text), F.lit(word.lower()))


def reply(hits: Column) -> Column:
    """The reply over an array of (title, text): how many there are, then each title with the start of its text, HTML escaped."""
    lines = F.transform(hits, lambda h, i: F.concat((i + 1).cast("string"), F.lit(". **"), snippet(h["title"], 1 << 20), F.lit("**\n"), snippet(h["text"]), F.lit("\n\n")))
    return F.when(F.size(hits) == 0, NOT_FOUND).otherwise(F.concat(F.format_string(FOUND, F.size(hits)), F.array_join(lines, "")))


def _selected(docs: DataFrame, questions: list[str], rule, key: str) -> DataFrame:
    """question, n, sources (the least three keys) and best (the title of the first); a row per question, also without documents.

    The questions are a bounded list, so each document is held against all of them in its row.
    """
    marks = F.filter(F.array(*[F.when(rule(q), F.lit(i)) for i, q in enumerate(questions)]), lambda x: x.isNotNull())
    hits = docs.select(key, "title", F.explode(marks).alias("_q"))
    counts = hits.groupBy("_q").agg(F.count("*").alias("n"))
    first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("_q").orderBy(key))).where("_k <= 3")
    top = first.groupBy("_q").agg(F.array_sort(F.collect_list(F.struct("_k", key, "title"))).alias("_top"))
    asked = docs.sparkSession.createDataFrame(list(enumerate(questions)), "_q int, question string")
    joined = asked.join(counts, "_q", "left").join(top, "_q", "left")
    return joined.select("question", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.transform("_top", lambda t: t[key]).alias("sources"), F.get("_top", F.lit(0))["title"].alias("best"))


def gated_answers(docs: DataFrame, questions: list[str], keywords=GATE_KEYWORDS, key: str = "doc_id") -> DataFrame:
    """question, n, sources, best, confidence. docs: key, title, text.

    A document counts where its title holds the question, or its text one of the keywords that the question holds too.
    confidence: 0 without documents, else 0.5 and 0.1 for each, 0.9 at most.
    """

    def rule(q: str) -> Column:
        return reduce(lambda a, k: a | _holds(F.col("text"), k), [k for k in keywords if k.lower() in q.lower()], _holds(F.col("title"), q))

    found = _selected(docs, questions, rule, key)
    return found.withColumn("confidence", F.when(F.col("n") > 0, F.round(F.least(F.lit(0.9), 0.5 + F.col("n") * 0.1), 2)).otherwise(F.lit(0.0)))


def reasoned_answers(docs: DataFrame, questions: list[str], keywords=REASON_KEYWORDS, always: tuple = ("气功",), key: str = "doc_id") -> DataFrame:
    """question, n, sources, best, thoughts: documents whose text holds a keyword of the question or one of `always`, and the steps that led there."""
    own = {q: [k for k in keywords if k in q] for q in questions}
    found = _selected(docs, questions, lambda q: reduce(lambda a, k: a | _holds(F.col("text"), k), own[q] + list(always), F.lit(False)), key)
    named = F.create_map(*[F.lit(x) for q in questions for x in (q, ", ".join(own[q]) or "通用知识查询")])
    last = F.when(F.col("n") > 0, F.concat(F.lit("生成答案: 基于 "), "best")).otherwise("生成答案: 使用通用回复")
    return found.withColumn("thoughts", F.array(F.concat(F.lit("分析问题: "), "question"), F.concat(F.lit("识别关键词: "), F.element_at(named, F.col("question"))), F.format_string("搜索结果: 找到 %d 篇相关文档", "n"), last))


def domain_answers(docs: DataFrame, asked: list[tuple[str, str, int, float, float]], key: str = "doc_id") -> DataFrame:
    """domain, n, confidence, snippets: for each (domain, words, k, confidence with rows, without) the first k rows that hold the words in title or text, of which the first 150 characters are shown."""
    parts = []
    for domain, said, k, yes, no in asked:
        best = docs.where(F.ilike("title", F.lit(f"%{said}%")) | F.ilike("text", F.lit(f"%{said}%"))).orderBy(key).limit(k)
        lines = F.transform(F.array_sort(F.collect_list(F.struct(key, "title", "text"))), lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), h["title"], F.lit("\n   "), F.substring(h["text"], 1, 150), F.lit("...")))
        parts.append(best.agg(F.lit(domain).alias("domain"), F.count("*").alias("n"), F.when(F.count("*") > 0, yes).otherwise(no).alias("confidence"), F.array_join(lines, "\n\n").alias("snippets")))
    return reduce(DataFrame.unionByName, parts)


def domain_rows(docs: DataFrame, asked: list[tuple[str, str, int, float, float]], key: str = "doc_id") -> DataFrame:
    """domain, k, key, confidence: the rows behind domain_answers, concatenated; the surest domain first."""
    parts = []
    for domain, said, k, yes, _ in asked:
        best = docs.where(F.ilike("title", F.lit(f"%{said}%")) | F.ilike("text", F.lit(f"%{said}%"))).orderBy(key).limit(k)
        parts.append(best.select(F.lit(domain).alias("domain"), F.row_number().over(Window.orderBy(key)).alias("k"), key, F.lit(yes).alias("confidence")))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("confidence"), "domain", "k")


def tag_search(docs: DataFrame, said: str, k: int, key: str = "doc_id") -> DataFrame:
    """key, total: rows whose title, text or tags hold the words; those with them in the title first, then by how many tags hold them. total counts all of them, before the cut."""
    tags = F.size(F.filter("tags", lambda t: _holds(t, said)))
    found = docs.select(key, _holds(F.col("title"), said).alias("_t"), tags.alias("_n"), _holds(F.col("text"), said).alias("_x")).where("_t or _x or _n > 0")
    return found.orderBy(F.desc("_t"), F.desc("_n"), key).limit(k).select(key).join(found.agg(F.count("*").alias("total")))


def search_tool(context: Column, said: str) -> Column:
    """Lines for those of the first three (title, text) that hold the words, with 100 characters each."""
    hits = F.filter(F.slice(context, 1, 3), lambda c: _holds(c["title"], said) | _holds(c["text"], said))
    lines = F.transform(hits, lambda c: F.concat(F.lit("- "), c["title"], F.lit(": "), F.substring(c["text"], 1, 100), F.lit("...")))
    return F.when(F.size(context) == 0, "无可用上下文").when(F.size(hits) == 0, "未找到相关内容").otherwise(F.array_join(lines, "\n"))


def lookup_tool(title: Column, text: Column, order: Column, topic: str) -> Column:
    """An aggregate: the first row, by `order`, whose title holds the topic, with 200 characters."""
    hit = F.min_by(F.concat(title, F.lit(": "), F.substring(text, 1, 200)), F.when(_holds(title, topic), order))
    return F.coalesce(F.when(F.count_if(_holds(title, topic)) > 0, hit), F.lit(f"未找到关于'{topic}'的知识"))


def final_answer(first: Column, last: Column, n: Column) -> Column:
    """What the last step (action, observation) observed, if it is 'finish' and saw something; else a summary of the contents of the first three of n steps."""
    numbered = F.filter(F.transform(first, lambda c, i: F.struct((i + 1).alias("i"), c.alias("c"))), lambda s: F.coalesce(s["c"], F.lit("")) != "")
    lines = F.transform(numbered, lambda s: F.concat(s["i"].cast("string"), F.lit(". "), F.substring(s["c"], 1, 100), F.lit("...\n")))
    summary = F.concat(F.format_string("基于%d步推理，得出以下结论：\n\n", n), F.array_join(lines, ""))
    return F.when((last["action"] == "finish") & (F.coalesce(last["observation"], F.lit("")) != ""), last["observation"]).otherwise(summary)


def first_rows(df: DataFrame, key: str, order: str, n: int = 3) -> DataFrame:
    """The first n rows of each key; only these leave a partition."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def prompt(question: Column, context: Column, kind: Column, templates: dict[str, str]) -> Column:
    """The template of the question's kind with {question} and {context} filled in; that of '' where the kind has none."""
    chosen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in templates.items() for x in pair]), kind), F.lit(templates[""]))
    return F.replace(F.replace(chosen, F.lit("{question}"), question), F.lit("{context}"), context)
