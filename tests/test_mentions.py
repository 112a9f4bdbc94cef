"""Dictionary names against regular expressions."""

import random
import re
import time

import pytest

from loomlake.operators.graph import ENTITY_PATTERNS
from loomlake.operators.mentions import Names, close_pairs, contained, entities, listed, mentions

SETS = [
    ENTITY_PATTERNS,
    {"a": "(ab|a|abc|b)", "b": "(bc|c|ab)", "c": "(cab|a)"},
    {"x": "(aa|a|aaa)", "y": "(ba|ab)"},
]


def brute_entities(text, patterns):
    found = {}
    for t, p in patterns.items():
        for m in re.finditer(p, text):
            found.setdefault(m.group(), t)
    return list(found.items())


def brute_pairs(text, names, gap=50):
    out = []
    for i, a in enumerate(names):
        out += [(a, b) for b in names[i + 1 :] if re.search(f"{a}.{{0,{gap}}}{b}|{b}.{{0,{gap}}}{a}", text)]
    return out


def texts(seed, patterns, n):
    rng = random.Random(seed)
    names = [x for p in listed(patterns).values() for x in p]
    for _ in range(n):
        yield "".join(rng.choice([rng.choice(names), rng.choice(names)[:1], " " * rng.randrange(1, 60), "\n", "\r", " ", "x", "🙂"]) for _ in range(rng.randrange(25)))


@pytest.mark.parametrize("patterns", SETS)
@pytest.mark.parametrize("gap", [50, 3, 0])
def test_as_regular_expressions_find_them(patterns, gap):
    own = Names(listed(patterns))
    for text in texts(1, patterns, 400):
        hits = own.hits(text)
        assert [(own.names[k], own.types[t]) for k, t in own.entities(hits).items()] == brute_entities(text, patterns)
        names = [n for n, _ in brute_entities(text, patterns)]
        key = lambda p: (names.index(p[0]), names.index(p[1]))
        assert [(own.names[a], own.names[b]) for a, b in own.near(text, hits, gap)] == sorted(brute_pairs(text, names, gap), key=key)


def test_rows(spark):
    data = [(1, "练八段锦时气沉丹田", 1), (2, None, 1), (3, "", 1), (4, "心肝", 1), (4, "心肝", 1), (None, "气血", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, name int")
    types = listed(ENTITY_PATTERNS)
    rows = [(r.doc_id, r.ordinal, r.name, r.type) for r in entities(docs, types).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, "八段锦", "功法"), (1, 1, "气", "概念"), (1, 2, "丹田", "概念"), *[(4, 0, "心", "脏腑"), (4, 1, "肝", "脏腑")] * 2, (None, 0, "气", "概念")], key=str)
    assert sorted((r.doc_id, r.source, r.target) for r in close_pairs(docs, types).collect() if r.doc_id) == sorted([(1, "八段锦", "气"), (1, "八段锦", "丹田"), (1, "气", "丹田"), *[(4, "心", "肝")] * 2])
    found = {(r.name, r.begin, r.end, r.taken) for r in mentions(docs, types).where("doc_id is null").collect()}
    assert found == {("气", 0, 1, True), ("气血", 0, 2, False)}
    assert {(r.doc_id, r.name) for r in contained(docs, ["血", "气血", "段锦时", ""]).collect()} == {(1, "段锦时"), (None, "血"), (None, "气血")}
    assert entities(docs.limit(0), types).count() == 0 and contained(docs, []).count() == 0 and entities(docs, {}).count() == 0


@pytest.mark.parametrize("unit", ["气" * 40, "心x肝y脾z" * 6, "the quick brown fox jumps over ", "丹田\n", "气丹田气血"])
def test_two_million_characters_of_a_line(unit):
    own, text = Names(listed(ENTITY_PATTERNS)), (unit * (2_000_000 // len(unit)))
    began = time.process_time()
    own.near(text, own.hits(text), 50)
    assert time.process_time() - began < 12
