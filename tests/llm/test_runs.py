"""Periodic runs against the definition, and how often symbols are compared."""

import hashlib
import random
import zlib

import pytest

from loomlake.llm.runs import collapsed, lyndon_edges, op13_lyndon_runs, periodic_runs, runs_of, text_runs

SF = "/root/testdata/sf0.001"


def brute_runs(word, exponent=4, least=6):
    """Every stretch with period q that can't go on, if no smaller period holds in it."""
    n, found = len(word), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and word[e] == word[e + q]:
                e += 1
            length = e + q - i
            if length >= max(least, exponent * q) and not any(all(word[k] == word[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = e
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_edges(word):
    n = len(word)
    after = [next((j for j in range(i + 1, n) if word[j:] < word[i:]), n) for i in range(n)]
    return after, [next((k for k in range(n - j) if word[i + k] != word[j + k]), n - j) for i, j in enumerate(after)]


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes(rng):
    for _ in range(400):
        yield [rng.randrange(rng.choice((1, 2, 3, 5))) for _ in range(rng.randrange(40))]
    for _ in range(200):
        out = []
        while len(out) < 60:
            out += [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
        yield out
    yield from (fibonacci(k) for k in (10, 50, 90))


def test_edges_are_next_smaller_suffixes():
    for word in shapes(random.Random(1)):
        assert lyndon_edges(word) == brute_edges(word)


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 5)])
def test_runs_are_those_of_the_definition(exponent, least):
    for word in shapes(random.Random(2)):
        assert runs_of(word, exponent, least) == brute_runs(word, exponent, least)


class Symbol:
    reads = 0

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        Symbol.reads += 1
        return self.value == other.value

    def __lt__(self, other):
        Symbol.reads += 1
        return self.value < other.value


@pytest.mark.parametrize("make", [lambda n: [1] * n, lambda n: [1] * (n - 1) + [0], fibonacci, lambda n: ([0, 1] * n)[:n], lambda n: [i.bit_count() % 2 for i in range(n)], lambda n: ([0] * 99 + [1]) * (n // 100), lambda n: [int(c) for k in range(1, n) for c in "0" * k + "1"][:n]])
def test_comparisons_are_linear(make):
    for n in (4000, 16000):
        Symbol.reads = 0
        lyndon_edges([Symbol(x) for x in make(n)])
        assert Symbol.reads <= 6 * n


def test_stretches_lose_no_run():
    rng = random.Random(3)
    for word in shapes(rng):
        text = [b"w%d" % x for x in word]
        assert text_runs(text) == brute_runs(word)
    filler = [b"f%d" % k for k in range(300)]
    text = filler + [b"a"] * 6 + filler[:50] + [b"a", b"b", b"c"] * 4 + [b"a"] + filler
    assert text_runs(text) == [(300, 6, 1), (356, 13, 3)]
    assert collapsed(text, text_runs(text)) == filler + [b"a"] + filler[:50] + [b"a", b"b", b"c"] + filler


def test_rows(spark):
    data = [(1, "a a a a a a", 7), (2, None, 7), (3, "", 7), (4, " \n\t", 7), (5, "x\x0by", 7), (5, "x\x0by", 7), (None, "é é é é é é ü", 7)]
    rows = periodic_runs(spark.createDataFrame(data, "doc_id long, text string, runs int")).collect()
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in rows}
    assert len(rows) == 7 and got[1] == ([(0, 6, 1)], "a") and got[2] == got[3] == got[4] == ([], "") and got[5] == ([], "x y") and got[None] == ([(0, 6, 1)], "é ü")
    assert periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_very_long_text(spark):
    text = " ".join(["one two three"] * 40_000 + [f"w{i}" for i in range(150_000)])
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.runs] == [(0, 120_000, 3)] and len(row.collapsed.split()) == 150_003


def expected(doc_id, text):
    ws = (text or "").encode().split()
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = fast_brute(ws)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {k for s, m, p in runs for k in range(s + p, s + m)}
    kept = b" ".join(w for k, w in enumerate(ws) if k not in dropped)
    told = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (doc_id, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def fast_brute(ws):
    import numpy as np

    names = np.unique(np.array(ws, object), return_inverse=True)[1] if ws else np.zeros(0, int)
    found = []
    for q in range(1, len(ws) // 4 + 1):
        same = np.concatenate([[False], names[:-q] == names[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for b, e in zip(edges[::2], edges[1::2]):
            m = int(e - b + q)
            if m >= max(6, 4 * q) and not any(q % d == 0 and (names[b : b + m - d] == names[b + d : b + m]).all() for d in range(1, q)):
                found.append((int(b), m, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = op13_lyndon_runs(spark, SF)
    assert rows.columns == columns and [t for _, t in rows.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = {expected(r.doc_id, r.text) for r in docs}
    assert {tuple(r) for r in rows.collect()} == want and sum(w[1] > 0 for w in want) > 5
