"""Sizes and keys at which operators once broke: counts beyond 64-bit products, null and repeated ids."""

from pyspark.sql import functions as F

import loomlake.llm.toxicity as T
from loomlake.llm.decontam import decontaminate
from loomlake.llm.mixing import hypergeometric, mix_sources
from loomlake.llm.sharding import shard_documents


def test_hypergeometric_of_a_hundred_terabytes(spark):
    long = lambda x: F.lit(x).cast("long")
    drawn = lambda n, k, m, u: spark.range(1).select(hypergeometric(long(n), long(k), long(m), F.lit(u)).alias("x")).first().x
    n = 140_000_000_000
    deviation = (n / 16) ** 0.5  # from the mode outwards, so that u is the probability of lying as near
    for u, far in ((0.6827, 1), (0.9545, 2)):
        assert abs(abs(drawn(n, n // 2, n // 2, u) - n // 4) - far * deviation) < deviation / 50
    assert drawn(n, n - 1, 3, 0.5) == 3 and drawn(n, 5, 1_000_000_000, 0.5) in (0, 1)


def test_null_ids_are_mixed_in_many_chunks(spark, monkeypatch):
    import loomlake.llm.mixing as M

    seen = []
    save = M.Scratch.save
    monkeypatch.setattr(M.Scratch, "save", lambda self, df, name: seen.append(df) or save(self, df, name) if name == "sizes" else save(self, df, name))
    rows = spark.createDataFrame([(None, f"some words {i}", "s") for i in range(1000)], "doc_id long, text string, source string")
    out = mix_sources(rows).select("taken", "size").collect()
    assert sum(r.taken for r in out) == sum(r["size"] for r in out) == 3000
    assert seen[0].select("_chunk").distinct().count() > 300


def test_null_ids_are_sharded_in_many_parts(spark):
    rows = spark.createDataFrame([(None, f"text {i}") for i in range(500)], "doc_id long, text string")
    out = shard_documents(rows, 4).collect()
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(4)) and len(out) == 500


def test_the_fit_holds_a_row_for_each_chosen_id(spark, monkeypatch):
    held = []
    real = T.log_odds
    monkeypatch.setattr(T, "log_odds", lambda rows, columns, toxic, size: held.append(len(toxic)) or real(rows, columns, toxic, size))
    docs = spark.createDataFrame([(1, f"a nice day {i % 7}") for i in range(20_000)] + [(2, "you awful thing"), (3, "calm words"), (None, "x")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    T.fit_toxicity(docs, labels, sample=2)
    assert held and held[0] <= 4


ITEM = "Maria bought 12 apples and 7 pears at the market in Lisbon before walking home to bake a very large pie for Peter"


def test_items_with_null_and_repeated_ids_are_found(spark):
    docs = spark.createDataFrame([(1, f"Intro. {ITEM}. Outro."), (2, "nothing to see in this text at all, it is short and plain"), (3, "The second thing is a wholly different question about trains leaving stations early in the morning on rails")], "doc_id long, text string")
    second = "a wholly different question about trains leaving stations early in the morning on rails"
    for ids in ((None, None), (7, 7), (None, 7)):
        items = spark.createDataFrame([(ids[0], ITEM), (ids[1], second)], "item_id long, text string")
        got = {r.doc_id: (r.n_items, r.item_ids, r.contaminated) for r in decontaminate(docs, items).collect()}
        assert got == {1: (1, [ids[0]], True), 2: (0, [], False), 3: (1, [ids[1]], True)}
    texts = spark.createDataFrame([("x", ITEM), (None, second), (None, None)], "item_id string, text string")
    assert {r.doc_id: r.item_ids for r in decontaminate(docs, texts).collect()} == {1: ["x"], 2: [], 3: [None]}
