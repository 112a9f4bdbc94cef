"""Near-duplicate groups against all pairs on whole sets."""

import random
import re

import pytest

from loomlake.llm import minhash
import numpy as np

from loomlake.llm.minhash import components, near_duplicates, super_minhash
from loomlake.llm.common import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORDS.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n):
    sets = {d: shingles(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    docs = [(500, None), (501, ""), (502, " \t"), (503, "Only three words"), (504, "only THREE words"), (505, "É a"), (506, "é a")]
    for base in range(12):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([8, 60, 300]))]
        for copy in range(rng.randint(1, 14)):
            edited = [w if rng.random() > 0.02 * (copy % 5) else f"e{rng.randint(0, 99)}" for w in words]
            docs.append((len(docs) * 7 % 491, " ".join(w.upper() if copy % 3 == 0 else w for w in edited)))
    rng.shuffle(docs)
    return list({d: t for d, t in docs}.items())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("chunk", [512, 4])
def test_groups(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, rid int").repartition(3)
    rows = near_duplicates(frame, words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_repeated_ids_and_empty_table(spark):
    rows = near_duplicates(spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.rid: r.comp for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_words_that_polynomials_confuse(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"x {a} y"), (2, f"x {b} y"), (3, f"x {a} y")]
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_signatures_in_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    text = np.repeat(np.arange(6), [3, 200, 0 + 1, 900, 40, 2])
    elements = rng.integers(0, 2**63, len(text)).astype(np.uint64)
    whole = super_minhash(text, elements, 7)
    monkeypatch.setattr(minhash, "PART", 37)
    assert (super_minhash(text, elements, 7) == whole).all() and np.isinf(whole[6]).all()
    share = [(super_minhash(np.zeros(400, int), elements[s : s + 400], 1) == super_minhash(np.zeros(400, int), elements[:400], 1)).mean() for s in (0, 50, 200)]
    assert share[0] == 1 and abs(share[1] - 350 / 450) < 0.12 and abs(share[2] - 200 / 600) < 0.12


def test_long_text_and_refused_threshold(spark):
    long = " ".join(f"w{i}" for i in range(2_400_000))
    rows = near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=70)
