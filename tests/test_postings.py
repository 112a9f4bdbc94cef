"""The stored lexical index against the scan, and what its bounds spare."""

import random

import pytest

from loomlake.functions import text as T
from loomlake.operators import postings, retrieval
from loomlake.sources import stored as S


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [*texts, texts[0], texts[0], None, "", "İstanbul ΟΔΟΣ x² foo_bar 八段锦 a"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(corpus(1, 1500))), "doc_id long, text string").repartition(5).cache()
    path = str(tmp_path_factory.mktemp("index"))
    postings.build(docs, path, width=4, parts=4)
    return docs, path


def rows(df):
    return sorted((r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("query", ["w1 w2 w300", "w5 w5 W5", "w399", "nothing here", "", "foo_bar 八段锦 İstanbul"])
def test_scores_are_those_of_the_scan(spark, indexed, query):
    docs, path = indexed
    tokens = spark.createDataFrame([(query,)], "text string").select(T.tokens("text").alias("t")).first().t
    assert rows(postings.scored(spark, path, query)) == rows(retrieval.bm25(docs, tokens))


def test_search_of_a_set_equals_the_scan_and_skips_blocks(spark, indexed):
    docs, path = indexed
    rng = random.Random(2)
    asked = [(i, " ".join(f"w{rng.choice([rng.randrange(20), rng.randrange(400)])}" for _ in range(rng.randrange(1, 9)))) for i in range(12)] + [(90, ""), (91, None), (92, "unheard"), (93, corpus(1, 1)[0])]
    found, work = postings.search(spark, path, spark.createDataFrame(asked, "q long, text string"), 5, "q", probes=8)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], []).append((r["rank"], r.doc_id, round(r.score, 9)))
    for q, text in asked:
        scan = sorted(rows(retrieval.bm25(docs, (text or "").split())), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(q, [])) == [(k + 1, *x) for k, x in enumerate(scan)]
    work = work.collect()
    assert sum(r.read for r in work) < 0.6 * sum(r.blocks for r in work) and all(r.read <= r.blocks for r in work)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    postings.build(docs, str(tmp_path / "i"))
    assert postings.scored(spark, str(tmp_path / "i"), "word").count() == 0
    assert postings.search(spark, str(tmp_path / "i"), spark.createDataFrame([(1, "word")], "query long, text string"))[0].count() == 0


def test_an_index_is_built_once_for_each_state_of_the_files(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(path)

    def build(folder):
        built.append(folder)
        spark.range(1).write.parquet(f"{folder}/x")

    write(3)
    first = S.kept(spark.read.parquet(path), "some", build)
    assert S.kept(spark.read.parquet(path), "some", build) == first and len(built) == 1 and spark.read.parquet(f"{first}/x").count() == 1
    write(4)
    assert S.kept(spark.read.parquet(path), "some", build) != first and len(built) == 2

    def broken(folder):
        build(folder)
        raise ValueError

    write(5)
    with pytest.raises(ValueError):
        S.kept(spark.read.parquet(path), "some", broken)
    S.kept(spark.read.parquet(path), "some", build)
    assert len(built) == 4
