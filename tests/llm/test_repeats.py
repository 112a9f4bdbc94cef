"""Suffix structures against sorting, and both removals against brute force over all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomlake.llm import repeats, substring_dedup as words_module, suffix_dedup as bytes_module
from loomlake.llm.substring_dedup import substring_dedup
from loomlake.llm.suffix_dedup import suffix_dedup
from loomlake.llm.suffixes import SuffixAutomaton, suffix_array

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def test_suffix_array_is_the_sorted_order_of_suffixes():
    rng = random.Random(1)
    for _ in range(800):
        text = [rng.randint(1, rng.choice((1, 2, 4))) for _ in range(rng.randint(0, 40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(2))
        lengths, counts = SuffixAutomaton(a).matching(b, 5)
        for i, (n, c) in enumerate(zip(lengths, counts)):
            assert n == max(k for k in range(min(5, i + 1) + 1) if b[i + 1 - k : i + 1] in a)
            assert not n or c == sum(a.startswith(b[i + 1 - n : i + 1], j) for j in range(len(a)))


def brute_bytes(docs, length):
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        out[d] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(data, gone) if not g))
    return out


def brute_words(docs, length):
    split = {d: WORDS.findall(t or "") for d, t in docs}
    count = Counter(tuple(w[s : s + length]) for w in split.values() for s in range(len(w) - length + 1))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if count[tuple(w[s : s + length])] > 1:
                gone[s : s + length] = [True] * length
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["ab", "b", "né", "日本", "x y", "aa", "c"] + [f"w{i}" for i in range(40)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(4)]
    docs = [(900, None), (901, ""), (902, " \n\t "), (903, "a" * 400), (904, "a" * 350), (905, "ab " * 150)]
    for d in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), rng.choice([" ", "\n", "　"]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))]
        docs.append((d, rng.choice([" ", "  ", "\n"]).join(parts)))
    docs += [(1000 + i, docs[10 + i % 3][1]) for i in range(9)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed)
    frame = spark.createDataFrame([(*r, "extra") for r in docs], SCHEMA + ", rid string").repartition(5)
    rows = suffix_dedup(frame, length=100).collect()
    want = brute_bytes(docs, 100)
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in rows} == want and len(rows) == len(docs)
    assert any(x[1] for x in want.values())


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_dedup(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = corpus(seed)
    rows = substring_dedup(spark.createDataFrame(docs, SCHEMA).repartition(5), length=15, gram=6, step=4).collect()
    want = brute_words(docs, 15)
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in rows} == want and len(rows) == len(docs)


def test_repeated_ids_and_empty_table(spark):
    long = "one two three four five six seven eight nine ten " * 3
    rows = suffix_dedup(spark.createDataFrame([(1, long), (1, long), (None, None)], SCHEMA)).collect()
    assert sorted(len(r.kept) for r in rows)[0] == 0 and len(rows) == 3
    assert suffix_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_bins_change_nothing(spark, monkeypatch):
    docs = corpus(7)
    monkeypatch.setattr(repeats, "BIN", 200)
    rows = suffix_dedup(spark.createDataFrame(docs, SCHEMA), length=60, gram=20, step=8).collect()
    assert {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in rows} == {d: hashlib.sha256(x[3]).hexdigest() for d, x in brute_bytes(docs, 60).items()}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def opposites(n):
    """Two words whose polynomial hashes modulo a power of two are the same."""
    return thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024, 2048])
def test_words_that_polynomials_confuse(spark, n):
    a, b = opposites(n)
    words = [f"w{i}" for i in range(50)]
    docs = [(i, " ".join(words[:25] + [x] + words[25:])) for i, x in enumerate((a, b))]
    rows = substring_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert all(not r.spans for r in rows)
    same = substring_dedup(spark.createDataFrame([(0, docs[0][1]), (1, docs[0][1])], SCHEMA)).collect()
    assert all(len(r.kept) == 0 for r in same)


def test_only_the_solver_removes(spark, monkeypatch):
    docs = corpus(1)
    monkeypatch.setattr(bytes_module, "classes_by_suffix_array", lambda text, starts, length: np.arange(len(starts)))
    monkeypatch.setattr(words_module, "classes_by_automaton", lambda text, starts, length: np.arange(len(starts)))
    frame = spark.createDataFrame(docs, SCHEMA)
    assert not any(r.spans for r in suffix_dedup(frame, length=60, gram=20, step=8).collect())
    assert not any(r.spans for r in substring_dedup(frame, length=15, gram=6, step=4).collect())


def test_slices_of_long_texts_change_nothing(spark, monkeypatch):
    docs = [(i, "\n".join(t or "" for _, t in corpus(i)[:40])) for i in range(4)]
    monkeypatch.setattr(repeats, "SLICE", 150)
    rows = suffix_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in rows} == brute_bytes(docs, 100)
    rows = substring_dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in rows} == brute_words(docs, 35)


def test_text_of_twenty_megabytes(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(2_400_000)) + " " + passage
    assert len(long) > 20_000_000
    docs = spark.createDataFrame([(1, long), (2, f"other start {passage} other end")], SCHEMA)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup(docs).collect()}
    assert got[1] == [] and len(got[2]) == 1 and got[2][0][1] - got[2][0][0] in (len(passage) + 1, len(passage))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substring_dedup(docs).collect()}
    assert got == {1: [(2_400_000, 2_400_060)], 2: [(2, 62)]}
