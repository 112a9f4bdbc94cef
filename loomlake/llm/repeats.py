"""Windows of symbols that occur more than once in a corpus, found exactly and without collecting the corpus anywhere.

What suffix-array and substring deduplication share. A symbol is a byte or a word, a window is `length` of them.

1. Anchors. Of the grams in a window the one with the least hash is its anchor; equal windows have equal anchors at equal
   places. So windows that share no anchor's gram with another place can't repeat, and most of the text drops out here.
2. Runs. The windows of an anchor are its run; runs with equal content are one class, which its first place and, where it
   has more, one other place stand for.
3. Stretches. Where runs of several classes share an anchor's gram, each class is cut by the windows' places relative to
   the anchor into stretches of `step` windows. All windows of a stretch have a common core of length - step + 1 symbols;
   what differs is the slack, up to step - 1 symbols at each side.
4. Solving. Runs and stretches become strings of symbols: a run is one symbol, as equal runs have equal names; a stretch is
   slack, core, slack, where the core is one symbol. Both places of a class give their strings. A solver (suffix array or
   suffix automaton) finds which windows of a bin of strings are equal, and only what it finds is removed. A bin has a
   bounded size; the windows of a core with more than HOT places go in one by one, dealt to bins by their whole content.

Names (of runs, cores and words) are 128-bit keyed hashes, the key drawn anew for each call; slack is compared itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BATCH_BYTES, column, eights, hash_bytes, hash_symbols, hash_windows, pieces, windowed_least, word_spans
from .common import Scratch, secret, spread_join

HOT = 4000  # places of a core above which its windows are strings of their own
BIN = 150_000  # symbols in a bin
SLICE = BATCH_BYTES  # windows of a long text that are looked at together
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Kind:
    """What is compared: bytes or words; windows of `length`, anchors of `gram`, stretches of `step` windows."""

    unit: str
    length: int
    gram: int
    step: int

    def __post_init__(self):
        if self.unit not in ("bytes", "words") or not 1 <= self.gram <= self.length or not 1 <= self.step <= min(32, self.length - self.gram + 1):
            raise ValueError(f"not a kind of window: {self}")

    @property
    def width(self) -> int:
        """Bytes of a symbol in the slack."""
        return 1 if self.unit == "bytes" else 8


@dataclass
class Units:
    """Symbols of consecutive texts: `views` are one or two sequences of 64-bit numbers (eight bytes from each place on, or two hashes of each word)."""

    kind: Kind
    data: np.ndarray
    views: tuple[np.ndarray, ...]
    bounds: np.ndarray  # first symbol of each text, and the total
    spans: tuple  # starts and ends of the words

    @classmethod
    def of(cls, kind: Kind, data: np.ndarray, offsets: np.ndarray, key: int) -> Units:
        if kind.unit == "bytes":
            return cls(kind, data, (eights(data),), offsets, ())
        starts, ends, bounds = word_spans(data, offsets)
        return cls(kind, data, tuple(hash_bytes(data, starts, ends, key + k) for k in (1, 2)), bounds, (starts, ends))

    def names(self, starts: np.ndarray, ends: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Two keyed hashes of slices of symbols."""
        if self.kind.unit == "bytes":
            return tuple(hash_bytes(self.data, starts, ends, key + k) for k in (3, 4))
        return tuple(hash_symbols(v, starts, ends, key + k) for k, v in zip((3, 4), self.views))


def _under(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in disjoint intervals."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def find_anchors(units: Units, key: int):
    """(text, gram hash, anchor, windows before it, windows) of each run of windows that have one anchor; long texts slice by slice."""
    kind, bounds, total = units.kind, units.bounds, int(units.bounds[-1])
    view = units.views[0]
    g = kind.gram
    offsets = list(range(g)) if kind.unit == "words" else sorted({*range(0, g - 7, 8), max(g - 8, 0)})
    last = np.uint64(2**64 - 1) if kind.unit == "words" or g >= 8 else np.uint64((1 << 8 * g) - 1)
    found = []
    for a in range(0, max(total - kind.length + 1, 0), SLICE):
        b = min(total, a + SLICE + kind.length - 1)
        n = b - a
        grams = hash_windows(view[a : a + n] & last if last != np.uint64(2**64 - 1) else view[a : a + n], offsets, n - g + 1, key)
        least = windowed_least((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), kind.length - g + 1)
        lo, hi = np.clip(bounds[:-1] - a, 0, len(least)), np.clip(bounds[1:] - kind.length + 1 - a, 0, len(least))
        valid = np.flatnonzero(_under(lo[lo < hi], hi[lo < hi], len(least)))  # windows that end within their text
        if not len(valid):
            continue
        at = (least[valid] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        count = np.diff(np.append(new, len(valid)))
        at, first = at[new], valid[new]
        text = np.searchsorted(bounds, first + a, "right") - 1
        found.append((text, grams[at], at + a - bounds[text], at - first, count))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _slices(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated slices of `source`."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return source[np.arange(total) + shift]


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    data, offsets = column(batch, "text")
    for lo, hi in pieces(offsets):
        yield data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo, hi


ROWS = SLICE // 8  # rows in a batch


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict(columns)
    for at in range(0, whole.num_rows, ROWS):
        yield whole.slice(at, ROWS)


def _anchor_rows(batches: Iterator[pa.RecordBatch], kind: Kind, key: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        for data, offsets, lo, _ in _cut(batch):
            units = Units.of(kind, data, offsets, key)
            text, grams, at, lead, n = find_anchors(units, key)
            start = units.bounds[text] + at - lead
            names = units.names(start, start + n - 1 + kind.length, key)
            r1 = names[0] + (lead * 4096 + n).astype(np.uint64)
            yield from _batches({"rid": rids[lo + text], "h": grams.view(np.int64), "r1": r1.view(np.int64), "r2": names[1].view(np.int64), "at": at.astype(np.int32), "lead": lead.astype(np.int32), "n": n.astype(np.int32)})


def _stretch_rows(batches: Iterator[pa.RecordBatch], kind: Kind, key: int) -> Iterator[pa.RecordBatch]:
    step, length, width = kind.step, kind.length, kind.width
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(batch.schema.get_field_index("cells"))
        cells, cell_at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        fields = [cells.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        for data, offsets, lo, hi in _cut(batch):
            units = Units.of(kind, data, offsets, key)
            cell_text = np.repeat(np.arange(hi - lo), np.diff(cell_at[lo : hi + 1]))
            for c in range(int(cell_at[lo]), int(cell_at[hi]), ROWS // 4):
                own = slice(c, min(c + ROWS // 4, int(cell_at[hi])))
                at, lead, n = (f[own] for f in fields)
                text = cell_text[c - int(cell_at[lo]) :][: len(at)]
                far, near = lead, lead - n + 1  # the anchor's places in the first and the last window
                many = far // step - near // step + 1
                k = np.repeat(np.arange(len(at)), many)
                j = near[k] // step + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
                x_lo, x_hi = np.maximum(near[k] - j * step, 0), np.minimum(far[k] - j * step, step - 1)
                pos = units.bounds[text[k]] + at[k] - j * step
                end = pos - step + 1 + length
                g1, g2 = units.names(pos, end, key)
                g1 = g1 + j.astype(np.uint64)
                both = np.empty(2 * len(k), np.int64), np.empty(2 * len(k), np.int64)
                both[0][::2], both[0][1::2] = pos - x_hi, end
                both[1][::2], both[1][1::2] = x_hi, step - 1 - x_lo
                slack = _slices(data if width == 1 else units.views[0], *both).view(np.uint8)
                ends = np.concatenate([[0], np.cumsum((x_hi + step - 1 - x_lo) * width)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": rids[lo + text[k]], "g1": g1.view(np.int64), "g2": g2.view(np.int64), "pos": (pos - units.bounds[text[k]]).astype(np.int32), "lo": x_lo.astype(np.int32), "hi": x_hi.astype(np.int32),
                        "slack": pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(slack))]),
                    }
                )


#: Symbols of a bin, starts of windows in them, and the windows' length; returns the number of each window's class.
Solver = Callable[[list[int], np.ndarray, int], np.ndarray]


def bin_strings(kind: Kind, cores: list[tuple], lo: list[int], hi: list[int], slacks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The bin's symbols (above 0), and for every window its start in them, its string and its x. A string is left slack, core, right slack."""
    text: list[int] = []
    starts, owner, xs = [], [], []
    names: dict[int, int] = {}
    if kind.width == 8:
        values = [[names.setdefault(v, len(names) + 2) for v in np.frombuffer(s, np.int64).tolist()] for s in slacks]
        base = len(names) + 2
    else:
        values = [[v + 2 for v in s] for s in slacks]
        base = 258
    core_names: dict[tuple, int] = {}
    for k, (g, a, b, v) in enumerate(zip(cores, lo, hi, values)):
        at = len(text)
        text += v[:b]
        text.append(core_names.setdefault(g, base + len(core_names)))
        text += v[b:]
        text.append(1)
        for x in range(a, b + 1):
            starts.append(at + b - x)
            owner.append(k)
            xs.append(x)
    return text, np.asarray(starts), np.asarray(owner), np.asarray(xs)


CLASS = ("g1", "g2", "lo", "hi", "slack")
SOLVED = "g1 long, g2 long, lo int, hi int, slack binary, rid long, pos int, copies long, first_mask long, rest_mask long"


def _solve(batches: Iterator[pa.RecordBatch], kind: Kind, solver: Solver, earlier: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Classes come sorted by key. A bin ends where a key ends, before it has more than `most` symbols if it can.

    first_mask, rest_mask: which windows of the class's first place, and of all its other places, the solver has found elsewhere.
    """

    def masks(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        own = {x: table.column(x).to_numpy() for x in ("g1", "g2", "lo", "hi", "rid", "pos", "rid2", "pos2", "copies")}
        again = np.flatnonzero(own["copies"] > 1)
        rows = np.concatenate([np.arange(n), again])
        slacks = table.column("slack").to_pylist()
        cores = list(zip(own["g1"][rows].tolist(), own["g2"][rows].tolist()))
        text, starts, owner, xs = bin_strings(kind, cores, own["lo"][rows].tolist(), own["hi"][rows].tolist(), [slacks[i] for i in rows.tolist()])
        classes = solver(text, starts, kind.step)
        order = np.lexsort((np.concatenate([own["pos"], own["pos2"][again]]), np.concatenate([own["rid"], own["rid2"][again]])))
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        if earlier:  # covered where the class of equal windows has an earlier place
            least = np.full(classes.max() + 1, len(rows), np.int64)
            np.minimum.at(least, classes, rank[owner])
            covered = rank[owner] > least[classes]
        else:
            covered = np.bincount(classes)[classes] > 1
        bits = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(bits, owner, np.where(covered, np.int64(1) << xs, 0))
        rest = np.zeros(n, np.int64)
        rest[again] = bits[n:]
        out = {x: table.column(x) for x in (*CLASS, "rid", "pos", "copies")}
        return pa.Table.from_pydict({**out, "first_mask": bits[:n], "rest_mask": rest}).combine_chunks().to_batches()[0]

    cost = 2 * (2 * kind.step if kind.step > 1 else 2)
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(t.num_rows for t in held) * cost < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table.column("key").to_numpy()
        edges = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        at = 0
        for e0, e1 in zip(edges[:-1], edges[1:]):
            if (e1 - at) * cost > most and e0 > at:
                yield masks(table.slice(at, e0 - at))
                at = e0
        if len(edges) > 1 and edges[-2] > at:
            yield masks(table.slice(at, edges[-2] - at))
            at = edges[-2]
        held = table.slice(at).combine_chunks().to_batches()
    if held and sum(t.num_rows for t in held):
        yield masks(pa.Table.from_batches(held).combine_chunks())


def _solved(classes: DataFrame, kind: Kind, solver: Solver, earlier: bool) -> DataFrame:
    """classes: key (equal windows have equal ones), CLASS, copies, first and other (rid, pos). Tasks are as many as shuffle partitions, as solving takes time where bytes are few."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thin = classes.select("key", *CLASS, "first.rid", "first.pos", F.col("other.rid").alias("rid2"), F.col("other.pos").alias("pos2"), "copies")
    return thin.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(partial(_solve, kind=kind, solver=solver, earlier=earlier, most=BIN), SOLVED)


def _judged(rows: DataFrame, solved: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """rows with `mask`, what the solver has found for the place that each row is."""
    found = solved.where("first_mask != 0 or rest_mask != 0").select(*keys, F.struct("rid", "pos").alias("first"), "first_mask", "rest_mask", "copies")
    joined = spread_join(rows, found, keys, rows.count())
    return joined.withColumn("mask", F.when(F.struct("rid", "pos") == F.col("first"), F.col("first_mask")).otherwise(F.col("rest_mask"))).where("mask != 0")


def repeated_windows(docs: DataFrame, kind: Kind, solver: Solver, earlier: bool, scratch: Scratch) -> DataFrame:
    """rid, pos, mask: bit x of mask says that the window at pos - x repeats; below 0, that -mask windows from pos on do.

    docs: rid (unique), text. earlier: only windows that also start earlier (smaller rid, or same rid and earlier start)
    count; else all that start anywhere else. Keys that many rows share are joined by broadcast; every grouping combines
    before its shuffle. Intermediate tables are deleted as soon as no later step reads them.
    """
    key = secret()
    anchors = scratch.save(docs.mapInArrow(partial(_anchor_rows, kind=kind, key=key), "rid long, h long, r1 long, r2 long, at int, lead int, n int"), "anchors")
    shared = scratch.save(anchors.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "shared")
    runs = scratch.save(spread_join(anchors, shared, ["h"], anchors.count()).withColumn("pos", F.col("at") - F.col("lead")), "runs")
    scratch.drop("anchors", "shared")
    place = F.struct("rid", "pos", "at", "lead", "n")
    firsts = scratch.save(runs.groupBy("h", "r1", "r2").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("other")), "firsts")
    zero, empty = F.lit(0), F.lit(b"")
    equal = firsts.where("copies > 1").select(F.col("r1").alias("key"), F.col("r1").alias("g1"), F.col("r2").alias("g2"), zero.alias("lo"), zero.alias("hi"), empty.alias("slack"), "copies", "first", "other")
    solved = scratch.save(_solved(equal, replace(kind, step=1), solver, earlier).withColumnsRenamed({"g1": "r1", "g2": "r2"}), "solved-runs")
    whole = scratch.save(_judged(runs, solved, ["r1", "r2"], scratch).select("rid", "pos", (-F.col("n")).cast("long").alias("mask")), "whole")
    scratch.drop("runs", "solved-runs")
    several = firsts.groupBy("h").count().where("count > 1").select("h")
    cells = firsts.join(several, "h", "left_semi").groupBy("first.rid").agg(F.collect_list(F.struct("first.at", "first.lead", "first.n")).alias("cells"))
    stretches = scratch.save(docs.join(cells, "rid").mapInArrow(partial(_stretch_rows, kind=kind, key=key), "rid long, g1 long, g2 long, pos int, lo int, hi int, slack binary"), "stretches")
    scratch.drop("firsts")
    return whole.unionByName(_partly(stretches, kind, solver, earlier, scratch))


def _partly(stretches: DataFrame, kind: Kind, solver: Solver, earlier: bool, scratch: Scratch) -> DataFrame:
    """rid, pos, mask of the windows of stretches that share their core with other stretches."""
    groups = scratch.save(stretches.groupBy("g1", "g2").agg(F.count("*").alias("copies")).where("copies > 1").withColumn("places", F.col("copies")), "groups")
    w, r = kind.width, kind.step
    single = F.expr(f"concat(substring(slack, (hi - x) * {w} + 1, x * {w}), substring(slack, hi * {w} + 1, ({r - 1} - x) * {w}))")
    each = F.when(F.col("places") > HOT, F.sequence("lo", "hi")).otherwise(F.array(F.lit(None).cast("int")))
    dealt = spread_join(stretches, groups, ["g1", "g2"], stretches.count()).withColumn("x", F.explode(each)).withColumn("own", F.when(F.col("x").isNull(), F.col("slack")).otherwise(single))
    key = F.when(F.col("x").isNull(), F.col("g1")).otherwise(F.xxhash64("g1", "x", "own"))
    rows = scratch.save(dealt.select("rid", "pos", "g1", "g2", F.coalesce("x", "lo").alias("lo"), F.coalesce("x", "hi").alias("hi"), F.col("own").alias("slack"), key.alias("key")), "rows")
    scratch.drop("stretches", "groups")
    place = F.struct("rid", "pos")
    classes = scratch.save(rows.groupBy("key", *CLASS).agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.max(place).alias("other")), "classes")
    solved = scratch.save(_solved(classes, kind, solver, earlier), "solved")
    scratch.drop("classes")
    found = scratch.save(_judged(rows, solved, list(CLASS), scratch).select("rid", "pos", "mask"), "partly")
    scratch.drop("rows", "solved")
    return found


def _intervals(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, each within a text, as maximal runs that no end of a text is within."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > reach[:-1]) | (np.isin(starts[1:], bounds) & (starts[1:] != starts[:-1]))
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return starts[new], reach[last]


def _removals(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(batch.schema.get_field_index("hits"))
        hits, hit_at = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        poss, masks = (hits.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        for data, offsets, lo, hi in _cut(batch):
            spans, bounds = (), offsets
            if kind.unit == "words":
                *spans, bounds = word_spans(data, offsets)
            own = slice(int(hit_at[lo]), int(hit_at[hi]))
            text = np.repeat(np.arange(hi - lo), np.diff(hit_at[lo : hi + 1]))
            pos, mask = bounds[text] + poss[own], masks[own]
            whole = mask < 0
            parts = [pos[~whole & ((mask >> x) & 1 == 1)] - x for x in range(kind.step)]
            starts = np.concatenate([pos[whole], *parts])
            ends = np.concatenate([pos[whole] - mask[whole] - 1, *parts]) + kind.length
            run_starts, run_ends = _intervals(starts, ends, bounds)
            run_text = np.searchsorted(bounds, run_starts, "right") - 1
            runs = pa.StructArray.from_arrays([pa.array((run_starts - bounds[run_text]).astype(np.int32)), pa.array((run_ends - bounds[run_text]).astype(np.int32))], ["start", "end"])
            run_at = np.searchsorted(run_text, np.arange(hi - lo + 1)).astype(np.int32)
            gone = _under(run_starts, run_ends, int(bounds[-1]))
            if kind.unit == "bytes":
                keep, out = ~gone, data
            else:
                ws, we = spans[0][~gone], spans[1][~gone]
                of = np.searchsorted(offsets, ws, "right") - 1
                follow = np.flatnonzero(of[1:] == of[:-1])  # kept words with another one behind them
                keep, out = _under(ws, we, len(data)), data.copy()
                keep[we[follow]] = True
                out[we[follow]] = 0x20
            counts = np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])[offsets]
            kept = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.ascontiguousarray(counts)), pa.py_buffer(np.ascontiguousarray(out[keep]))])
            yield pa.RecordBatch.from_pydict({"rid": rids[lo:hi], "n_units": np.diff(bounds), "spans": pa.ListArray.from_arrays(pa.array(run_at), runs), "kept": kept})


def remove_windows(docs: DataFrame, hits: DataFrame, kind: Kind) -> DataFrame:
    """rid, n_units, spans (start, end in symbols, maximal and in order) and kept (binary: the bytes left, or the words left joined by one space) of every row."""
    per_doc = hits.groupBy("rid").agg(F.collect_list(F.struct("pos", "mask")).alias("hits"))
    return docs.join(per_doc, "rid", "left").select("rid", "text", "hits").mapInArrow(partial(_removals, kind=kind), "rid long, n_units long, spans array<struct<start:int,end:int>>, kept binary")
