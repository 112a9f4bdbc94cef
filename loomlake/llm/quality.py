"""Quality rules by weak supervision.

Rules vote on each document (1 good, -1 bad) or abstain (0). Expectation-maximisation over the counts of vote patterns
estimates how often each rule is right on good and on bad documents, and a document's posterior probability of being good
takes the place of "passes every rule".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, table, words

WINDOW = 5
KEEP = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(ws: Column, window: int) -> Column:
    """Words in windows that occur twice or more in the text.

    A window is the hash of its words. Where all differ the answer is 0; else windows are sorted to find those with an
    equal neighbour, and their positions, sorted again, cover min(window, gap to the next) words each. So the cost is
    that of sorting, however long the text.
    """

    def covered(hashes: Column) -> Column:
        def by_position(at: Column) -> Column:
            reach = F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window))))
            return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

        def twins(pairs: Column) -> Column:
            at = F.transform(pairs, lambda x, k: F.when((x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["i"]))
            return let(F.sort_array(F.array_compact(at)), by_position)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twins))

    def windows(h: Column) -> Column:
        n = F.greatest(F.size(h) - F.lit(window - 1), F.lit(0))
        return F.transform(F.slice(h, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(windows(h), covered))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs, less the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed. Null and blank texts count 0 and fail."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    counts = let(words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws, WINDOW).alias("r")))
    out = (
        docs.withColumn("_counts", counts)
        .withColumn("n_words", F.col("_counts.n").cast("long"))
        .withColumn("word_chars", F.length(bare).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("_counts.r").cast("long"))
        .drop("_counts", "text")
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def default_rules() -> dict[str, Column]:
    """Rule name to vote. Each looks at the base counts."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(F.col("n_words") >= 40, F.col("n_words") < 15),
        "word_length": vote((F.col("word_chars") / n).between(3, 9), (F.col("word_chars") / n < 2) | (F.col("word_chars") / n > 14)),
        "symbols": vote(F.col("n_symbols") * 50 < n, F.col("n_symbols") * 10 > n),
        "lines": vote(F.col("n_dup_lines") == 0, F.col("n_dup_lines") >= 3),
        "repeats": vote(F.col("n_repeat_words") * 20 <= n, F.col("n_repeat_words") * 10 > n),
    }


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], steps: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and for each rule how often its vote is right on good and on bad documents.

    patterns: votes by rule and how many documents cast them; with k rules at most 3**k of them. Expectation-maximisation
    of two classes with independent votes given the class, started from the rules' majority; counts are smoothed by one
    right and half a wrong vote, so that a rule that never votes keeps a neutral weight. No patterns: neutral values.
    """
    k = len(patterns[0][0]) if patterns else 0
    share, right = 0.5, [(0.8, 0.8)] * k
    good = [1 / (1 + math.exp(-sum(v))) for v, _ in patterns]
    for _ in range(steps):
        total = sum(c for _, c in patterns)
        share = (sum(g * c for g, (_, c) in zip(good, patterns)) + 1) / (total + 2)
        fresh = []
        for j in range(k):
            a = sum(g * c for g, (v, c) in zip(good, patterns) if v[j] == 1)
            b = sum(g * c for g, (v, c) in zip(good, patterns) if v[j] == -1)
            x = sum((1 - g) * c for g, (v, c) in zip(good, patterns) if v[j] == -1)
            y = sum((1 - g) * c for g, (v, c) in zip(good, patterns) if v[j] == 1)
            fresh.append(((a + 1) / (a + b + 1.5), (x + 1) / (x + y + 1.5)))
        right = fresh
        weights = vote_weights(right)
        prior = math.log(share / (1 - share))
        good = [1 / (1 + math.exp(-max(-500, min(500, prior + sum(w[0] if x == 1 else w[1] if x == -1 else 0 for x, w in zip(v, weights)))))) for v, _ in patterns]
    return share, right


def vote_weights(right: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Log-odds that a good and a bad vote of each rule add."""
    return [(math.log(a / (1 - b)), math.log((1 - a) / b)) for a, b in right]


def quality_filter(docs: DataFrame, rules: dict[str, Column] | None = None, keep: float = KEEP) -> DataFrame:
    """docs (doc_id, text, and more columns, which stay unless the result has that name) less the text, with the base counts, base_failed, p_good and kept.

    kept: not base_failed and p_good >= keep. Only the counts of vote patterns, at most 3**rules rows, reach the driver.
    Repeated rows and ids keep a row each; an empty table gives an empty result; a null vote abstains.
    """
    rules = rules or default_rules()
    scratch = Scratch(docs.sparkSession, "quality")
    counted = scratch.save(base_counts(docs), "counts")
    votes = [F.coalesce(v, F.lit(0)).cast("int") for v in rules.values()]
    patterns = [(tuple(r["v"]), r["count"]) for r in counted.groupBy(F.array(*votes).alias("v")).count().orderBy("v").collect()]
    share, right = fit_accuracies(patterns)
    logit = F.lit(math.log(share / (1 - share)))
    for v, (good, bad) in zip(votes, vote_weights(right)):
        logit = logit + F.when(v == 1, F.lit(good)).when(v == -1, F.lit(bad)).otherwise(F.lit(0.0))
    return counted.withColumn("p_good", 1 / (1 + F.exp(-logit))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_filter(docs).select("doc_id", *BASE, "base_failed", "p_good", "kept")
