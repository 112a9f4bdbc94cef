"""Token counts against a search over all segmentations, and toxicity on held-out labels."""

import random
from functools import lru_cache

import numpy as np

from loomlake.llm.token_counts import count_words, piece_endings, token_counts
from loomlake.llm.toxicity import fit_ordinal, fit_toxicity, toxicity

SF = "/root/testdata/sf0.01"


def brute_count(word, scores, single):
    @lru_cache(None)
    def best(at):
        if at == len(word):
            return (0.0, 0)
        options = []
        for end in range(at + 1, len(word) + 1):
            score = scores.get(word[at:end], single if end == at + 1 else None)
            if score is not None:
                options.append((score + best(end)[0], -best(end)[1] - 1))
        score, n = max(options)
        return (score, -n)

    return best(0)[1]


def test_counts_are_those_of_the_best_segmentation():
    rng = random.Random(5)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))): -rng.randint(1, 9) * 1.0 for _ in range(25)}
    words = sorted({bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12))) for _ in range(400)})
    assert count_words(words, piece_endings(pieces), -20.0) == [brute_count(w, pieces, -20.0) for w in words]


def test_token_counts_by_document(spark):
    docs = [(1, "the the word"), (2, None), (3, ""), (4, " \n"), (5, "the"), (5, "the"), (6, "日本 ☃ naïve")]
    rows = token_counts(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_words string")).collect()
    by = {r.doc_id: (r.n_words, r.n_tokens) for r in rows}
    assert len(rows) == 7 and by[2] == by[3] == by[4] == (0, 0) and by[5][0] == 1
    one = token_counts(spark.createDataFrame([(1, "word"), (2, "x" * 3000), (3, "y" * 3000)], "doc_id long, text string")).collect()
    assert by[1][1] == 2 * by[5][1] + {r.doc_id: r.n_tokens for r in one}[1] and by[6][0] == 3 and by[6][1] >= 3
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ordinal_fit_orders_the_thresholds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    grade = np.digitize(2 * x + rng.logistic(size=600), [-1.0, 1.0, 3.0])
    model = fit_ordinal(np.arange(600), np.zeros(600, int), x, grade, 1, steps=400)
    assert (np.diff(model.thresholds) > 0).all() and abs(model.weights[0] - 2) < 0.5
    assert np.allclose(model.thresholds, [-1, 1, 3], atol=0.5)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels.where("pmod(xxhash64(doc_id), 2) = 0"))
    held = labels.where("pmod(xxhash64(doc_id), 2) = 1").withColumnRenamed("toxic", "truth")
    rows = toxicity(docs.select("doc_id", "text"), model).join(held, "doc_id").select("truth", "toxic", "severity").collect()
    toxic, clean = [r for r in rows if r.truth == 1], [r for r in rows if r.truth == 0]
    assert sum(r.toxic for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.toxic for r in clean) <= 0.005 * len(clean)
    assert (np.diff(model.thresholds) > 0).all() and max(r.severity for r in toxic) > 2


def test_toxicity_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "-- ..", 1), (3, "-- ..", 1)], "doc_id long, text string, grade int")
    assert [(r.severity, r.toxic) for r in toxicity(docs, None).collect()] == [(0.0, False)] * 4
    full, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(full, labels)
    assert [(r.severity, r.toxic) for r in toxicity(docs, model).collect()] == [(0.0, False)] * 4
    assert fit_toxicity(docs, labels.where("false")) is None


def test_words_that_polynomials_confuse(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    together = token_counts(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string")).first().n_tokens
    apart = token_counts(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert together == sum(r.n_tokens for r in apart)


def test_toxicity_of_empty_tables_and_clashing_columns(spark):
    full, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(full, labels)
    assert toxicity(full.limit(0), model).count() == 0 and fit_toxicity(full.limit(0), labels) is None
    row = toxicity(spark.createDataFrame([("mine", "t", 5)], "Severity string, text string, toxic int"), model).first()
    assert isinstance(row.severity, float) and row.toxic in (True, False)
