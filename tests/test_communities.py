"""Communities and modularity against plain Python on small graphs."""

import random
from collections import Counter, defaultdict

import pytest

from loomlake.operators.communities import communities, modularity


def brute_communities(edges, rounds=10):
    w = Counter()
    for a, b in edges:
        if a is not None and b is not None and a != b:
            w[a, b] += 1
            w[b, a] += 1
    label = {a: a for a, _ in w}
    quiet = 0
    for n in range(rounds):
        new = {}
        for v in label:
            votes = Counter({label[v]: 1})
            for (a, b), k in w.items():
                if a == v:
                    votes[label[b]] += k
            best = min(x for x in votes if votes[x] == max(votes.values()))
            new[v] = best if (best < label[v] if n % 2 == 0 else best > label[v]) else label[v]
        quiet = quiet + 1 if new == label else 0
        label = new
        if quiet == 2:
            break
    return label


def brute_modularity(edges, label):
    m, degree, within = 0, defaultdict(int), defaultdict(int)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            m += 1
            degree[label[a]] += 1
            degree[label[b]] += 1
            within[label[a]] += 2 * (label[a] == label[b])
    return sum(within[c] / (2 * m) - (degree[c] / (2 * m)) ** 2 for c in degree)


def planted(seed, groups=4, size=7):
    rng = random.Random(seed)
    v = [f"v{i:02d}" for i in range(groups * size)]
    edges = [(a, b) for i, a in enumerate(v) for j, b in enumerate(v) if i < j and rng.random() < (0.8 if i // size == j // size else 0.02)]
    return [*edges, ("v00", "v00"), ("v01", None), edges[0][::-1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    edges = planted(seed)
    frame = spark.createDataFrame(edges, "source string, target string").repartition(3)
    labels = communities(frame)
    got = {r.name: r.community for r in labels.collect()}
    assert got == brute_communities(edges)
    found = modularity(frame, labels).first()
    assert abs(found.modularity - brute_modularity(edges, got)) < 1e-12 and found.vertices == len(got) and found.communities == len(set(got.values()))
    assert found.modularity > 0.5


def test_empty(spark):
    frame = spark.createDataFrame([], "source string, target string")
    assert communities(frame).count() == 0 and modularity(frame, communities(frame)).first().modularity == 0.0
