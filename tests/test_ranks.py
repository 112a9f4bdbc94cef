"""Ranks by ranges, closures and rules against plain Python."""

import random

from pyspark.sql import functions as F

from loomlake.operators import graph, ranks, rules, tiering


def test_percentiles_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([rng.random(), 0.5, None])) for _ in range(3000)] + [("one", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for offset in (0, 1):
        got = {r.k: (r.n, r.a, r.b) for r in ranks.floor_percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95}, offset).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            vs = sorted(v for x, v in rows if x == k and v is not None)
            if vs:
                pick = lambda p: vs[min(int((len(vs) - offset) * p), len(vs) - 1)]  # noqa: E731, B023
                want[k] = (len(vs), pick(0.5), pick(0.95))
        assert got == want
    assert ranks.floor_percentiles(df.limit(0), ["k"], "v", {"a": 0.5}).count() == 0
    assert ranks.floor_percentiles(df, [], "v", {"a": 1.0}).first().a == max(v for _, v in rows if v is not None)


def test_numbers_of_a_whole_table(spark):
    rows = [(i, random.Random(i).randrange(50)) for i in range(2000)]
    got = ranks.numbered(spark.createDataFrame(rows, "i long, v long").repartition(5), [F.desc("v"), F.asc("i")]).collect()
    assert {r.i: r["rank"] for r in got} == {i: k + 1 for k, (i, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}
    moves = spark.createDataFrame([(i, "hot", "cold", float(i % 7)) for i in range(120)], "k long, tier string, target string, saving double")
    out = tiering.batches(moves, "k", 110).collect()
    assert len(out) == 110 and {r.batch for r in out} == {1, 2, 3} and sum(r.batch == 3 for r in out) == 10 and {r.latency_gain for r in out} == {-49.0}


def test_closure_of_cycles_and_chains(spark):
    rng = random.Random(3)
    edges = {(i, i + 1) for i in range(40)} | {(40, 20)} | {(rng.randrange(50, 70), rng.randrange(50, 70)) for _ in range(15)}
    frame = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in edges] + [(None, "v1")], "source string, target string")
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert {(r.source, r.target) for r in graph.closure(frame).collect()} == {(f"v{a}", f"v{b}") for a, b in want}
    assert graph.closure(frame.limit(0)).count() == 0


def test_prefix_rules(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    named = [(f"r{i}", i, word(rng.randrange(0, 6))) for i in range(40)] + [("none", 99, None)]
    paths = [word(rng.randrange(0, 9)) for _ in range(100)] + [None, ""]
    got = rules.match_prefixes(spark.createDataFrame(list(enumerate(paths)), "i long, path string"), "path", spark.createDataFrame(named, "rule string, ordinal long, prefix string")).collect()
    assert len(got) == len(paths)
    for r in got:
        held = [x for x in named if r.path is not None and x[2] is not None and r.path.startswith(x[2])]
        once = [x for x in held if x[1] == min(y[1] for y in held if y[2] == x[2])]
        assert r["first"] == (min(once, key=lambda x: (x[2] != r.path, x[1]))[0] if once else None)
        assert r.longest == (max(once, key=lambda x: len(x[2]))[0] if once else None)
