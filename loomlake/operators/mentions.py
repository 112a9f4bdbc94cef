"""Names of a dictionary in texts: every occurrence in one pass, those a pattern of alternatives would take, and names that stand close to each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAIRS = 1 << 20  # pairs of a step
MOST = 1_000_000  # names a dictionary may have, as every task holds it

Hit = tuple[int, int, int]  # begin, end, number of the name


class Names:
    """A dictionary of names by type, as an automaton; a name can have several types, and its place among those of each."""

    def __init__(self, types: dict[str, list[str]]):
        import ahocorasick

        self.types, self.names, self.roles = list(types), [], []
        number: dict[str, int] = {}
        for t, names in enumerate(types.values()):
            for rank, name in enumerate(dict.fromkeys(n for n in names if n)):
                if name not in number:
                    number[name] = len(self.names)
                    self.names.append(name)
                    self.roles.append([])
                self.roles[number[name]].append((t, rank))
        if len(self.names) > MOST:
            raise ValueError(f"a dictionary of over {MOST} names is not broadcast")
        self.sizes = [len(n) for n in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, k in number.items():
            self.automaton.add_word(name, k)
        if self.names:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[Hit]:
        """Every occurrence of every name, overlapping ones too, by begin and end."""
        if not self.names:
            return []
        return sorted((last + 1 - self.sizes[k], last + 1, k) for last, k in self.automaton.iter(text))

    def taken(self, hits: list[Hit]) -> list[tuple[int, Hit]]:
        """(type, hit) that a search for the names of each type finds, one type after another: from left to right, where several begin the one listed first, and none inside one that is taken."""
        by: list[list[tuple[int, int, Hit]]] = [[] for _ in self.types]
        for hit in hits:
            for t, rank in self.roles[hit[2]]:
                by[t].append((hit[0], rank, hit))
        out = []
        for t, found in enumerate(by):
            free = 0
            for begin, _, hit in sorted(found):
                if begin >= free:
                    out.append((t, hit))
                    free = hit[1]
        return out

    def entities(self, hits: list[Hit]) -> dict[int, int]:
        """Type by name of the names that are taken, each with its first type, in the order they are found."""
        first: dict[int, int] = {}
        for t, hit in self.taken(hits):
            first.setdefault(hit[2], t)
        return first

    def near(self, text: str, hits: list[Hit], gap: int) -> list[tuple[int, int]]:
        """Pairs of names found in the text, the one found first before the other, where one of both begins at most `gap` characters behind the end of the other on its line.

        An occurrence only meets what begins before the next occurrence of its own name ends, since that one is closer to
        everything behind; so a name repeated without end costs no more than its length.
        """
        place = {k: i for i, k in enumerate(self.entities(hits))}
        if len(place) < 2:
            return []
        begin, end, name = (np.array(x, np.int64) for x in zip(*[(b, e, place[k]) for b, e, k in hits if k in place]))
        order = np.lexsort((begin, name))
        again = np.full(len(name), np.iinfo(np.int64).max)
        same = name[order][1:] == name[order][:-1]
        again[order[:-1][same]] = end[order[1:][same]]
        lo = np.searchsorted(begin, end)
        hi = np.minimum(np.searchsorted(begin, end + gap, "right"), np.searchsorted(begin, again))
        lines = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10
        line = np.concatenate([[0], np.cumsum(lines)])
        upto, at, found = np.concatenate([[0], np.cumsum(np.maximum(hi - lo, 0))]), 0, set()
        while at < len(lo):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            n = np.diff(upto[at : to + 1])
            a = np.repeat(np.arange(at, to), n)
            b = np.arange(len(a)) - np.repeat(upto[at:to] - upto[at] - lo[at:to], n)
            on = (line[end[a]] == line[begin[b]]) & (name[a] != name[b])
            one, two = np.minimum(name[a[on]], name[b[on]]), np.maximum(name[a[on]], name[b[on]])
            found.update(np.unique(one * len(place) + two).tolist())
            at = to
        names = list(place)
        return [(names[x // len(place)], names[x % len(place)]) for x in sorted(found)]


def listed(patterns: dict[str, str]) -> dict[str, list[str]]:
    """Names by type of patterns that are plain alternatives in parentheses."""
    return {t: p.removeprefix("(").removesuffix(")").split("|") for t, p in patterns.items()}


def _rows(batches: Iterator[pa.RecordBatch], names, told: Callable[[Names, str], list[tuple]], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    own = names.value
    for batch in batches:
        at, out = [], []
        for i, text in enumerate(batch.column(1)):
            rows = told(own, text.as_py() or "")
            at += [i] * len(rows)
            out += rows
        columns = list(zip(*out)) if out else [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], ["key", *[n for n, _ in fields]])


def _told(docs: DataFrame, types: dict[str, list[str]], key: str, told: Callable[[Names, str], list[tuple]], fields: dict[str, str]) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names = docs.sparkSession.sparkContext.broadcast(Names(types))
    schema = f"key {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields.items())
    found = docs.select(key, "text").mapInArrow(partial(_rows, names=names, told=told, fields=[(n, kinds[t]) for n, t in fields.items()]), schema)
    return found.withColumnRenamed("key", key)


def _all(own: Names, text: str) -> list[tuple]:
    hits = own.hits(text)
    taken = {(t, hit) for t, hit in own.taken(hits)}
    return [(own.names[h[2]], own.types[t], h[0], h[1], (t, h) in taken) for h in hits for t, _ in own.roles[h[2]]]


def _each(own: Names, text: str) -> list[tuple]:
    return [(i, own.names[k], own.types[t]) for i, (k, t) in enumerate(own.entities(own.hits(text)).items())]


def _near(own: Names, text: str, gap: int) -> list[tuple]:
    return [(own.names[a], own.names[b]) for a, b in own.near(text, own.hits(text), gap)]


def _which(own: Names, text: str) -> list[tuple]:
    return [(own.names[k],) for k in {k: 0 for _, _, k in own.hits(text)}]


def mentions(docs: DataFrame, types: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """key, name, type, begin, end, taken: every occurrence of a name in a text, in characters; taken: whether a search for the type's names takes it.

    The dictionary is built once on the driver and broadcast; it is a parameter of at most MOST names and doesn't grow with docs. One pass over the
    texts without a shuffle, linear in them and in what is found. Null and empty texts have no rows; rows with the same key
    are told apart by nothing but their order.
    """
    return _told(docs, types, key, _all, {"name": "string", "type": "string", "begin": "int", "end": "int", "taken": "boolean"})


def entities(docs: DataFrame, types: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """key, ordinal, name, type: the names taken in each row, each once, in the order of the types and then of the text."""
    return _told(docs, types, key, _each, {"ordinal": "int", "name": "string", "type": "string"})


def close_pairs(docs: DataFrame, types: dict[str, list[str]], gap: int = 50, key: str = "doc_id") -> DataFrame:
    """key, source, target: names taken in a row, the source first, that stand within `gap` characters of each other on one line, in either order."""
    return _told(docs, types, key, partial(_near, gap=gap), {"source": "string", "target": "string"})


def contained(docs: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """key, name: the names that occur anywhere in a row's text, inside of words and of each other too."""
    return _told(docs, {"": names}, key, _which, {"name": "string"})
