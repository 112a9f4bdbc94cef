"""Domain scoring and routing of questions, and the texts of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gateway keywords by domain, in the order that breaks ties.
GATEWAY = {
    "qigong": ["气功", "八段锦", "五禽戏", "太极拳", "功法", "养生", "呼吸"],
    "tcm": ["中医", "中药", "针灸", "经络", "穴位", "方剂", "辨证"],
    "confucian": ["儒家", "孔子", "论语", "孟子", "仁义", "礼智"],
}


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a + F.contains(text, F.lit(w.lower())).cast("int"), words, F.lit(0))


def match_score(text: Column, keywords: list[str], categories: list[str]) -> Column:
    """0.3 for each keyword and 0.2 for each category that the text holds, 1 at most."""
    low = F.lower(text)
    return F.least(F.lit(1.0), _hits(low, keywords) * 0.3 + _hits(low, categories) * 0.2)


def domain_scores(questions: DataFrame, domains: list[tuple[str, int, list[str], list[str]]], key: str) -> DataFrame:
    """key, domain, priority, score: a row per question and domain (name, priority, keywords, categories), made within the row."""
    rows = F.array(*[F.struct(F.lit(n).alias("domain"), F.lit(p).alias("priority"), match_score(F.col("text"), k, c).alias("score")) for n, p, k, c in domains])
    return questions.select(key, F.inline(rows))


def route(questions: DataFrame, domains: list[tuple[str, int, list[str], list[str]]], key: str) -> DataFrame:
    """key, domain: the best by score, then priority; 'general' where none scores."""
    rows = F.array(*[F.struct(match_score(F.col("text"), k, c).alias("score"), F.lit(p).alias("priority"), F.lit(n).alias("domain")) for n, p, k, c in domains])
    best = F.array_max(rows)
    return questions.select(key, best.alias("b")).select(key, F.when(F.col("b.score") > 0, F.col("b.domain")).otherwise("general").alias("domain"))


def gateway_domain(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """The domain with the most keywords in the text; the first one on a tie, 'general' without any."""
    keywords = keywords or GATEWAY
    rows = F.array(*[F.struct(_hits(F.lower(text), w).alias("n"), F.lit(-i).alias("order"), F.lit(d).alias("domain")) for i, (d, w) in enumerate(keywords.items())])
    best = F.array_max(rows)
    return F.when(best["n"] > 0, best["domain"]).otherwise("general")


def snippet(text: Column, size: int = 150) -> Column:
    """The first characters with HTML escaped, and '...' where more follow."""
    out = F.substring(text, 1, size)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.concat(out, F.when(F.length(text) > size, "...").otherwise(""))


def context_of(hits: Column, most: int = 5) -> Column:
    """Numbered titles with the first 300 characters of an array of (id, title, text); a fixed phrase where it is empty."""
    lines = F.transform(F.slice(hits, 1, most), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["title"], F.lit("\n"), F.substring(h["text"], 1, 300)))
    return F.when(F.size(hits) == 0, "无相关上下文").otherwise(F.array_join(lines, "\n\n"))
