"""The index of three-letter runs against a scan."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import trigrams


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdeÄßİ 🙂%_\\\n") for _ in range(rng.randrange(80))) for _ in range(400)] + [None, "", "ab", "ABC", "Straße ÄÖÜ"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "abc without a key"), (3, "a second three abc")], "doc_id long, text string").repartition(3).cache()
    path = str(tmp_path_factory.mktemp("grams"))
    trigrams.build(docs, path, parts=4)
    return docs, path


@pytest.mark.parametrize("pattern", ["%abc%", "%ABC%", "abc", "%ab_d%e%", "%a\\%b%", "%äß%", "%ÄÖÜ%", "%i̇%", "%zzz%", "%a%", "%", "", "_bc%", "%abc%bca%", "%🙂 a%", "%a\\\\b%", "%cab%dea%"])
@pytest.mark.parametrize("pushed", [10_000, 0])
def test_equals_a_scan(spark, indexed, pattern, pushed, monkeypatch):
    monkeypatch.setattr(trigrams, "PUSHED", pushed)
    docs, path = indexed
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert rows(trigrams.ilike(docs, path, pattern)) == rows(docs.where(F.ilike("text", F.lit(pattern))))


def test_candidates_are_few(spark, indexed):
    docs, path = indexed
    assert trigrams.grams_of("%th_re%fore\\%x%") == ["for", "ore", "re%", "e%x"] and trigrams.grams_of("%a_b%") == []
    assert trigrams.candidates(spark, path, "%a%") is None
    found = trigrams.candidates(spark, path, "%abcde%").count()
    assert found <= docs.where("lower(text) like '%abc%' and lower(text) like '%bcd%'").count()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id string, text string")
    trigrams.build(docs, str(tmp_path / "i"))
    assert trigrams.ilike(docs, str(tmp_path / "i"), "%abc%").count() == 0
