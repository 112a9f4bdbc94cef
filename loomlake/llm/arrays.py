"""Texts as numpy arrays inside tasks: words, keyed hashes of slices, and exact names of words and shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 19
LONG = 512  # bytes of a slice above which it is hashed by BLAKE2b

#: Bytes of words: all but space and 9 to 13.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, the other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, 0 past the end; a view of one padded copy."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def _begin(n: np.ndarray, seed: int) -> np.ndarray:
    return mix(n.astype(np.uint64) * _ODD + np.uint64(seed & (2**64 - 1)))


def hash_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Keyed hash of each slice of bytes. Each step is a bijection of the state and of the eight bytes it takes in, so no algebra of the text carries over."""
    n, view = ends - starts, eights(data)
    out = _begin(n, seed)
    on = np.flatnonzero((n > 0) & (n <= LONG))
    step = 0
    while len(on):
        left = n[on] - 8 * step
        out[on] = mix((out[on] ^ (view[starts[on] + 8 * step] & _LAST[np.minimum(left, 8)])) * _ODD)
        step += 1
        on = on[left > 8]
    key = (seed & (2**64 - 1)).to_bytes(8, "little")
    for i in np.flatnonzero(n > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return out


def hash_symbols(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Keyed hash of each slice of a sequence of 64-bit symbols."""
    n = ends - starts
    out, on, step = _begin(n, seed), np.flatnonzero(n > 0), 0
    while len(on):
        out[on] = mix((out[on] ^ symbols[starts[on] + step]) * _ODD)
        step += 1
        on = on[n[on] > step]
    return out


def hash_windows(symbols: np.ndarray, offsets: list[int], count: int, seed: int) -> np.ndarray:
    """Keyed hash of the symbols at these offsets from each of the first `count` places."""
    out = np.full(count, seed & (2**64 - 1), np.uint64)
    for o in offsets:
        out = mix((out ^ symbols[o : o + count]) * _ODD)
    return out


def same_bytes(view: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> bool:
    """Whether the n bytes from a on equal those from b on, for all of them."""
    on, step = np.flatnonzero(n > 0), 0
    while len(on):
        left = n[on] - 8 * step
        last = _LAST[np.minimum(left, 8)]
        if ((view[a[on] + 8 * step] ^ view[b[on] + 8 * step]) & last).any():
            return False
        step += 1
        on = on[left > 8]
    return True


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(name, first place) of words: names count from 0, and are equal where the bytes are equal and nowhere else.

    Words are brought together by hash, and neighbours are then compared byte by byte; should unequal words ever have one
    hash, they are named through a dictionary instead.
    """
    hashes = hash_bytes(data, starts, ends, seed)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    a, b = order[:-1][same], order[1:][same]
    n = ends - starts
    if (n[a] != n[b]).any() or not same_bytes(eights(data), starts[a], starts[b], n[a]):
        known: dict[bytes, int] = {}
        names = np.array([known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(starts, ends)], np.int64)
        return names, np.unique(names, return_index=True)[1]
    new = np.concatenate([np.ones(min(len(order), 1), bool), ~same])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, order[new]


def shingle_names(names: np.ndarray, n: int) -> np.ndarray:
    """A name for each place's `n` names, equal where they are all equal and nowhere else; by naming pairs of shorter ones. The last n - 1 places have none."""
    if n == 1:
        return names
    m = (n + 1) // 2
    half = shingle_names(names, m)
    a, b = half[: len(names) - n + 1], half[n - m : len(names) - m + 1]
    return np.unique(a * (int(half.max(initial=0)) + 1) + b, return_inverse=True)[1].reshape(-1) if len(a) else a


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null has no bytes."""
    array = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64) if at else np.zeros(len(array) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; a longer text is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of the bytes of a kind) of consecutive texts, and for each text the number of its first word (with the total at the end)."""
    inside = kind[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    edges = offsets[(offsets >= 0) & (offsets <= len(data))]
    first = before.copy()
    first[edges] = False  # no word goes on from one text to the next
    starts = np.flatnonzero(inside & ~first[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = inside, False
    after[edges] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windowed_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of `width` consecutive keys."""
    least, have = keys, 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    return np.minimum(least[: len(keys) - width + 1], least[width - have :]) if have < width else least
