"""Shared helpers, and fits of models against simulation and search."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from loomlake.llm import common
from loomlake.llm.arrays import hash_bytes, shingle_names, word_names, word_spans
from loomlake.llm.quality import fit_accuracies
from loomlake.llm.toxicity import fit_ordinal


def test_a_cluster_without_a_shared_folder_is_refused():
    undefined = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)), master="yarn")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: {"spark.master": "yarn"}.get(name, default)), sparkContext=context)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HEAVY", 4)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2, 3, 3, 4] + [None] * 2)], "k int, i int")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (3, "c", 2)], "k int, v string, copies long")
    got = common.spread_join(left, right, ["k"], left.count(), how).select("k", "i", "v").collect()
    assert Counter(got) == Counter(left.join(right, "k", how).select("k", "i", "v").collect())


def test_columns_put_aside_come_back(spark):
    docs = spark.createDataFrame([(1, "x", 2)], "Rid int, text string, other int")
    named, back = common.aside(docs, "rid")
    assert named.columns == ["_own_Rid", "text", "other"] and named.select(*back).collect() == docs.collect()
    assert common.without(docs, "RID").columns == ["text", "other"]


def test_repeated_ids_are_numbered(spark):
    docs = spark.createDataFrame([(2, "b", "s"), (None, "a", "s"), (2, "a", "t"), (2, "a", "s")], "doc_id long, text string, source string")
    rows, same = common.keyed(docs, common.Scratch(spark, "t"), "source")
    assert not same and [(r.doc_id, r.text, r.source) for r in sorted(rows.collect(), key=lambda r: r.rid)] == [(None, "a", "s"), (2, "a", "s"), (2, "a", "t"), (2, "b", "s")]


def test_names_are_equal_where_words_are():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 8, 9, 17, 600]))) for _ in range(400)]
    words += words[:100]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    names, first = word_names(data, starts, ends)
    by_name = {}
    for w, n in zip(words, names.tolist()):
        assert by_name.setdefault(n, w) == w
    assert len(by_name) == len(set(words)) == len(first) and all(words[i] == by_name[n] for n, i in enumerate(first))
    for n in (1, 2, 3, 4, 5):
        shingle = shingle_names(names, n)[: len(words) - n + 1].tolist()
        seen = {}
        for i, s in enumerate(shingle):
            assert seen.setdefault(s, tuple(words[i : i + n])) == tuple(words[i : i + n])
        assert len(seen) == len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    assert len(set(hash_bytes(data, starts, ends, 5).tolist())) == len(set(words))


def test_names_survive_colliding_hashes(monkeypatch):
    from loomlake.llm import arrays

    monkeypatch.setattr(arrays, "hash_bytes", lambda data, starts, ends, seed: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"ab cd ab ef cd", np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    names, first = word_names(data, starts, ends)
    assert names.tolist() == [0, 1, 0, 2, 1] and first.tolist() == [0, 1, 3]


def test_accuracies_of_simulated_votes():
    rng = random.Random(6)
    right = [(0.9, 0.8), (0.75, 0.85), (0.7, 0.7), (0.95, 0.6)]
    patterns = Counter()
    for _ in range(40_000):
        good = rng.random() < 0.7
        patterns[tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < right[j][0]) else -1) if good else (-1 if rng.random() < right[j][1] else 1) for j in range(4))] += 1
    share, found = fit_accuracies(sorted(patterns.items()), steps=300)
    assert abs(share - 0.7) < 0.03 and all(abs(x - y) < 0.04 for got, want in zip(found, right) for x, y in zip(got, want))
    assert fit_accuracies([]) == (0.5, [])


def test_ordinal_fit_against_a_search_over_parameters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    grade = np.digitize(1.5 * x + rng.logistic(size=400), [-0.5, 1.5])

    def loss(w, first, step):
        above = 1 / (1 + np.exp(np.array([first, first + step])[None, :] - w * x[:, None]))
        edges = np.concatenate([np.ones((400, 1)), above, np.zeros((400, 1))], axis=1)
        i = np.arange(400)
        return -np.log(np.maximum(edges[i, grade] - edges[i, grade + 1], 1e-12)).mean()

    model = fit_ordinal(np.arange(400), np.zeros(400, int), x, grade, 1, steps=600, decay=0.0)
    best = min(loss(w, a, s) for w in np.arange(0.5, 2.6, 0.1) for a in np.arange(-1.5, 0.6, 0.1) for s in np.arange(1.0, 3.1, 0.1))
    assert loss(model.weights[0], model.thresholds[0], model.thresholds[1] - model.thresholds[0]) <= best + 1e-3
    assert math.isclose(model.expected(np.array([100.0]))[0], 2.0, abs_tol=1e-6)
