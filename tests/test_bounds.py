"""What tasks hold at a time does not grow with the rows that come together."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from loomlake.llm import decontam
from loomlake.operators import communities, postings, trigrams
from loomlake.operators import reports as R
from loomlake.sources import stored as S


def texts(n, words):
    rows = [" ".join(f"w{(7 * i + k) % 977}" for k in range(words)) for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(rows)], ["doc_id", "text"])


def test_token_counts_leave_in_pieces_of_bounded_text():
    batch = texts(1500, 900)
    out = list(postings._frequencies(iter([batch])))
    assert max(b.num_rows for b in out) <= 900 * 300 and sum(b.num_rows for b in out) == 1500 * 900
    whole = pa.Table.from_batches(out)
    assert whole.column(0).to_pylist() == [i for i in range(1500) for _ in range(900)] and set(whole.column(2).to_pylist()) == {1}


def test_pieces_hold_every_row_once_and_a_long_text_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "b" * 50, "c", "", "d" * 9])], ["doc_id", "text"])
    cut = lambda step: [b.column(0).to_pylist() for b in postings._pieces(iter([batch, batch.slice(0, 0)]), step, 10)]
    assert cut(1) == [[0, 1], [2], [3, 4, 5]] and cut(4) == [[0, 1, 2, 3], [4, 5]]


def test_blocks_of_the_index_leave_in_pieces_of_bounded_text(monkeypatch):
    monkeypatch.setattr(postings.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 3})())
    batch = texts(1500, 900)
    out = list(postings._blocks(iter([batch]), 8, 900.0))
    assert len(out) > 4 and max(b.num_rows for b in out) <= 977 * 300 / 8
    blocks = pa.Table.from_batches(out)
    assert set(blocks.column("block").to_pylist()) == {(3 << 32) + i for i in range(188)}
    assert sum(len(k) for k in blocks.column("keys").to_pylist()) == 1500 * 900


def test_attack_windows_equal_the_definition_with_ties_edges_and_rows_without_a_time(spark):
    rng, s = random.Random(5), 1_000_000
    times = [None] * 4 + [rng.choice([rng.randrange(4000 * s), rng.randrange(40) * 100 * s, rng.randrange(40) * 100 * s + 1]) for _ in range(300)]
    rows = [(t, k, f"ip{i % 3}") for i, t in enumerate(times) for k in ("a", "b")]
    got = R.attack_windows(spark.createDataFrame(rows, "micros long, kind string, ip string"), {"a": 4, "b": 50}, "kind", "ip", 300).collect()
    n = [sum(x is None if t is None else x is not None and t - 300 * s <= x <= t for x in times) for t in times]
    want = {(k, sum(x >= least for x in n), max(n)) for k, least in (("a", 4), ("b", 50)) if max(n) >= least}
    assert {(r.kind, r.alerts, r.worst) for r in got} == want
    few = spark.createDataFrame([(None, "a", "x")] * 3 + [(7, "a", "x")], "micros long, kind string, ip string")
    assert [(r.alerts, r.worst) for r in R.attack_windows(few, {"a": 3}, "kind", "ip", 300).collect()] == [(3, 3)]


def test_rounds_of_communities_store_numbers_not_names(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(communities, "stored", lambda df, name: kept.append((name, df.dtypes)) or S.stored(df, name))
    edges = spark.createDataFrame([("b", "a"), ("a", "é"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "a")], "source string, target string")
    got = {r.name: r.community for r in communities.communities(edges, 4).collect()}
    assert got == {"a": "a", "b": "a", "é": "a", "x": "x", "y": "x"}
    assert sum(name == "labels" for name, _ in kept) and all(kind != "string" for name, kinds in kept if name == "labels" for _, kind in kinds)


def test_patterns_of_several_parts_cost_no_power_of_the_text(spark):
    texts = ["ab_c", "aXbYc", "abc", "cab", "a\nB%c", "xaybzc", "ABAB", "İa", "", "aab", "b.a", None, "acb\nc"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for p in ("%a%b%", "a%b%c", "%a_b%c%", "a%%%b", "%b%c", "_%a%b%_", "%A%B%c", "%.%a%", "%%%", "a%_%_%c", "%i%a%"):
        got = docs.select(trigrams.like(spark, F.col("text"), p).alias("x"), F.ilike("text", F.lit(p)).alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got], p
    long = spark.createDataFrame([("der on " * 20_000,)], "text string")
    began = time.time()
    assert long.where(trigrams.like(spark, F.col("text"), "%der%on%der%on%zq%")).count() == 0 and time.time() - began < 20


def test_only_texts_that_share_a_window_are_shuffled(spark, monkeypatch):
    saved = {}
    save = decontam.Scratch.save
    monkeypatch.setattr(decontam.Scratch, "save", lambda self, df, name: saved.setdefault(name, save(self, df, name)))
    item = "why do small rivers run so slowly past the old stone mill in autumn"
    docs = spark.createDataFrame([(1, f"so {item} they asked"), (2, "nothing of that kind " * 5), (3, None)], "doc_id long, text string")
    out = decontam.decontaminate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {(r.doc_id, r.contaminated) for r in out.collect()} == {(1, True), (2, False), (3, False)}
    assert [r.rid for r in saved["named"].collect()] == [1]
