"""Targets, tree, draws and packing against plain Python."""

import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlake.llm import mixing
from loomlake.llm.mixing import hypergeometric, mix_sources, mixed_documents, mixed_pieces, permuted, splitting_tree, target_weights
from loomlake.llm.sharding import best_fit_decreasing, level_bins, shard_documents

DOCS = "doc_id long, text string, source string"


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(rng.choice([0, 3, 40, 400]))), rng.choice(["a", "b", "b", "b", "ü", None])) for i in range(n)]
    return rows + [(900, None, "a"), (901, "", None), (902, " \n", "b"), (rows[0][0], *rows[0][1:]), (None, "x y z", "only")]


def brute_targets(sizes, cycle=(5, 2, 1), most=3):
    """Caps are closed one after another until no share is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    open_, target, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 50, 900, 20000]) for s in ["b", "a", "é", "z", "Z", None, "c"]}
    got = target_weights(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()
    assert {r.source: pytest.approx(r.target, abs=1e-6) for r in got} == brute_targets(sizes)


def test_draws_are_the_quotas(spark):
    rows = corpus(5)
    got = mix_sources(spark.createDataFrame(rows, DOCS).repartition(3), block_words=16, shards=5).collect()
    words = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    assert len(got) == len(rows) and all(r["size"] == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]] for r in got)
    for s in sizes:
        own = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in own) == round(want[s]) and all(r.target == pytest.approx(want[s]) for r in own)
    for r in got:
        per_pass = Counter()
        for x in r.draws:
            per_pass.update((x["pass"], w) for w in range(x.first_word, x.first_word + x.n_words))
        assert set(per_pass.values()) <= {1} and sum(per_pass.values()) == r.taken <= 3 * r["size"]
    assert {x.shard for r in got for x in r.draws} == set(range(5))


def test_nothing_is_taken_without_the_tree(spark, monkeypatch):
    def bare(quotas, shards, seed):
        return quotas.select("rank", F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("n")) for s in range(shards)]).alias("bounds"))

    monkeypatch.setattr(mixing, "splitting_tree", bare)
    assert all(r.taken == 0 for r in mix_sources(spark.createDataFrame(corpus(5), DOCS)).collect())


def test_splitting_tree_is_exact(spark):
    quotas = {1: 1000, 2: 0, 3: 7, 4: 123456}
    rows = splitting_tree(spark.createDataFrame(list(quotas.items()), "rank int, quota long"), 6, 3).collect()
    assert {r.rank: sum(b.n for b in r.bounds) for r in rows} == quotas
    for r in rows:
        assert [b.shard for b in r.bounds] == list(range(6)) and [b.first for b in r.bounds] == [sum(x.n for x in r.bounds[:k]) for k in range(6)]
    totals = [sum(r.bounds[s].n for r in rows) for s in range(6)]
    assert max(totals) - min(totals) <= 3


def test_hypergeometric_law(spark):
    n, k, m, steps = 40, 13, 17, 4000
    u = spark.range(steps).select(((F.col("id") + 0.5) / steps).alias("u"))
    got = {r.x: r["count"] for r in u.select(hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.col("u")).alias("x")).groupBy("x").count().collect()}
    for x in range(k + 1):
        assert abs(got.get(x, 0) - steps * math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)) <= 2
    edge = spark.range(1).select(*[hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.4)).alias(str(i)) for i, (a, b, c) in enumerate([(0, 0, 0), (5, 5, 3), (5, 0, 3), (9, 4, 0), (9, 4, 9)])]).first()
    assert list(edge) == [0, 3, 0, 0, 4]


def test_permutation(spark):
    for of in (1, 2, 50):
        got = [r.y for r in spark.range(of).select(permuted(F.col("id"), F.lit(3), F.lit(of).cast("long")).alias("y")).collect()]
        assert sorted(got) == list(range(of))


def test_mixed_documents_and_pieces(spark):
    rows = [r for r in corpus(6) if r[0] is not None][:-1]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", extra string, shard int")
    draws = {r.doc_id: r for r in mix_sources(docs, block_words=16, shards=3).collect()}
    times = Counter(r.doc_id for r in mixed_documents(docs, block_words=16, shards=3).collect())
    assert times == Counter({i: 1 if not d["size"] else sum(x.first_word == 0 for x in d.draws) for i, d in draws.items()}) - Counter()
    pieces = mixed_pieces(docs, block_words=16, shards=3).collect()
    text = {i: (t or "").split() for i, t, _ in rows}
    assert sum(len(p.text.split()) for p in pieces) == sum(d.taken for d in draws.values())
    assert all(p.text in " ".join(text[p.doc_id]) for p in pieces)
    assert mix_sources(docs.limit(0)).count() == mixed_documents(docs.limit(0)).count() == 0


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fitting = [i for i, room in enumerate(bins) if room >= s]
        if fitting:
            bins[min(fitting, key=lambda i: (bins[i], i))] -= s
        else:
            bins.append(max(capacity, s) - s)
    return sorted(bins)


def test_best_fit_takes_sizes_as_item_by_item():
    rng = random.Random(8)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randint(0, 60))]
        runs = best_fit_decreasing(list(Counter(sizes).items()), 40)
        loads = Counter()
        for size, b, n in runs:
            loads[b] += size * n
        assert sorted(40 - x for x in loads.values()) == naive_best_fit(sizes, 40)
        assert Counter({s: sum(n for t, _, n in runs if t == s) for s in sizes}) == Counter(sizes)


def test_level_bins():
    rng = random.Random(9)
    classes = list(Counter(rng.randint(16, 500) for _ in range(3000)).items()) + [(400_000, 1), (90_000, 2)]
    loads = Counter()
    for size, b, n in level_bins(classes, 10):
        loads[b] += size * n
    assert len(loads) == 10 and sum(loads.values()) == sum(s * n for s, n in classes)
    small = sorted(loads.values())[:7]
    assert max(loads.values()) == 400_000 and small[-1] <= 1.01 * small[0]
    assert level_bins([], 4) == [] and {b for _, b, _ in level_bins([(5, 2)], 4)} == {0, 1}


def test_shards_of_odd_rows(spark):
    hot = "copy " * 40
    rows = [(i, hot) for i in range(300)] + [(1000 + i, f"text {i % 90} " * (1 + i % 7)) for i in range(600)] + [(5000, None), (5001, ""), (None, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, size string, copies int").repartition(4)
    got = shard_documents(docs, shards=6).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.text) for r in got) == Counter(rows) and {r.copies for r in got} == {3}
    groups, loads, slots = {}, Counter(), {}
    for r in got:
        assert r["size"] == len((r.text or "").encode()) + 16
        groups.setdefault(zlib.crc32((r.text or "").encode()), set()).add(r.shard)
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(g) == 1 for g in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    whole = 300 * (len(hot) + 16)
    rest = [v for v in loads.values() if v != whole]
    assert whole in loads.values() and len(rest) == 5 and max(rest) <= 1.05 * min(rest)
