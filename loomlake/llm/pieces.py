"""SentencePiece BPE with byte fallback: encoding that keeps each piece's span of source bytes, and decoding.

Only the model file is read through the public library's message definition; normalising, merging, spans and decoding are
done here, and tests hold them against the library.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import column, pieces
from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in pieces
CACHE = 600_000  # segments after which a worker forgets those it has not met since the last time
PIECE_BYTES = 1 << 21
SHORT, NEVER = 48, float("inf")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("bytewise", lambda e: ("\ufffd", e.start + 1))


class CharacterMap:
    """A compiled character map: a double-array trie over the UTF-8 bytes of what is replaced, and a pool of replacements that end in NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken and the replacement of the longest prefix of data[at:] that the map has.

        A unit of the array holds its label (low 8 bits), whether a value ends there (bit 8) and how far its children are
        (bits 10 to 30, in steps of 256 where bit 9 is set).
        """
        units, found = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    """A BPE model with byte fallback, read from a model file."""

    def __init__(self, path: str = MODEL, blob: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        if blob is None:
            with open(path, "rb") as f:
                blob = f.read()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, spaces before words and no symbols of the user's own are read")
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.begin, self.end = (self.names.index(x) for x in (model.trainer_spec.bos_piece, model.trainer_spec.eos_piece))
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        self.costs = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        byte_of = {k: bytes([b]) for b, k in self.bytes.items()}
        surfaces = [b"" if kind == CONTROL else byte_of[k] if kind == BYTE else (model.trainer_spec.unk_surface if kind == UNKNOWN else self.names[k].replace(SPACE, " ")).encode() for k, kind in enumerate(self.kinds)]
        self.pool, self.lengths = np.frombuffer(b"".join(surfaces), np.uint8), np.array([len(x) for x in surfaces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        kinds = np.array(self.kinds)
        self.is_control, self.is_byte = kinds == CONTROL, kinds == BYTE
        self.sizes = np.array([1 if kind == BYTE else len(n) for n, kind in zip(self.names, self.kinds)], np.int64)
        self.goes_on = np.array([0x80 <= byte_of.get(k, b"\0")[0] < 0xC0 for k in range(len(kinds))])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        joined = [p for p in self.ids if len(p) > 1]
        inner = sorted(set("".join(joined)) - {SPACE})
        # No piece goes on from another character to a space, nor beyond a character that only stands alone: texts fall
        # into segments there, which are encoded apart.
        if any(SPACE in p.lstrip(SPACE) for p in joined):
            self.segment = re.compile(".+", re.DOTALL)
        else:
            self.segment = re.compile(f"{SPACE}*[{''.join(map(re.escape, inner))}]+|{SPACE}+|.", re.DOTALL) if inner else re.compile(".", re.DOTALL)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The text as pieces see it, and for each of its characters the source byte it comes from (with the end of the source after the last).

        From left to right the longest prefix that the character map has is replaced, else a character stays; all
        characters of a replacement come from where its prefix begins.
        """
        if not text:
            return "", np.zeros(1, np.int64)
        space = SPACE if self.escape else " "
        if not self.map.units and not self.squeeze:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
            return (space + text.replace(" ", space), np.concatenate([[0], at])) if self.prefix else (text.replace(" ", space), at)
        data, at, out, source = text.encode(), 0, [], []
        while at < len(data):
            first = data[at]
            hit = self.map.longest(data, at)
            n = hit[0] if hit else 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            for c in hit[1].decode() if hit else data[at : at + n].decode():
                out.append(c)
                source.append(at)
            at += n
        if self.squeeze:
            low = next((k for k, c in enumerate(out) if c != " "), len(out))
            keep = [k for k in range(low, len(out)) if out[k] != " " or out[k - 1] != " "]
            at = source[low] if low < len(out) else at
            out, source = [out[k] for k in keep], [source[k] for k in keep]
        if not out:
            return "", np.array([at], np.int64)
        if self.prefix:
            out, source = [" ", *out], [source[0], *source]
        out, source = "".join(out).replace(" ", space), [*source, len(data)]
        if self.squeeze:
            out = out.rstrip(space)
        return out, np.array(source[: len(out) + 1], np.int64)

    def merged(self, segment: str) -> list[str]:
        """The segment in pieces: from single characters on, the pair whose piece has the highest score is joined, the leftmost of equals, until no pair is a piece.

        Short segments look over all pairs again for each step; long ones keep them in a queue. Both join the same pairs.
        """
        costs, parts, n = self.costs, list(segment), len(segment)
        if n <= SHORT:
            pairs = [costs.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            while pairs and (least := min(pairs)) < NEVER:
                k = pairs.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del pairs[k]
                if k:
                    pairs[k - 1] = costs.get(parts[k - 1] + parts[k], NEVER)
                if k < len(pairs):
                    pairs[k] = costs.get(parts[k] + parts[k + 1], NEVER)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(costs[p], k, p) for k in range(n - 1) if (p := parts[k] + parts[k + 1]) in costs]
        heapq.heapify(queue)
        while queue:
            _, k, piece = heapq.heappop(queue)
            right = after[k] if parts[k] else n
            if right >= n or len(parts[k]) + len(parts[right]) != len(piece) or parts[k] + parts[right] != piece:
                continue  # one of both has been joined to something else
            parts[k], parts[right] = piece, ""
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (p := piece + parts[after[k]]) in costs:
                    heapq.heappush(queue, (costs[p], k, p))
            if before[k] >= 0 and (p := parts[before[k]] + piece) in costs:
                heapq.heappush(queue, (costs[p], before[k], p))
        return [p for p in parts if p]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of a segment; a character without a piece is its bytes."""
        ids = [self.ids.get(p) for p in self.merged(segment)]
        if None in ids:
            ids = [i for p, i in zip(self.merged(segment), ids) for i in ([self.bytes[b] for b in p.encode()] if i is None else [i])]
        return ids

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """How many characters of the normalised text stand before the end of each piece. Of the bytes of a character the last one holds it."""
        sizes = self.sizes[ids]
        goes_on = np.append(self.goes_on[ids[1:]], False)
        sizes[self.is_byte[ids] & goes_on] = 0
        return np.cumsum(sizes)

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) of each piece, begin and end id included: its span of the source's UTF-8 bytes. The spans follow one another and cover the source."""
        seen, at = self.normalise(text)
        ids = np.array([i for s in self.segment.findall(seen) for i in self.segment_ids(s)], np.int32)
        ends, size = at[self.ends(ids)].tolist() if len(ids) else [], len(text.encode())
        spans = zip(ids.tolist(), [int(at[0]), *ends], ends)
        return [(self.begin, 0, 0), *spans, (self.end, size, size)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: neighbouring byte pieces are read as UTF-8 together (what is none is U+FFFD, byte by byte), control ids are nothing, and the first space is left out where the model puts one before texts."""
        ids = np.asarray(ids, np.int64)
        control = self.is_control[ids]
        rest = ids[~control]
        if control[1:-1].any():  # bytes are not read across control ids
            out = "".join(self._spelled(part[~self.is_control[part]]).decode("utf-8", "bytewise") for part in np.split(ids, np.flatnonzero(control)))
        else:
            out = self._spelled(rest).decode("utf-8", "bytewise")
        if self.prefix or self.squeeze:
            for i in rest:
                if self.kinds[i] != NORMAL or not self.names[i].startswith(SPACE):
                    break
                out = out[1:]
                if not self.squeeze or self.names[i] != SPACE:
                    break
        return out

    def _spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of ids one after another, put together by place."""
        n = self.lengths[ids]
        upto = np.cumsum(n)
        return self.pool[np.repeat(self.starts[ids] - upto + n, n) + np.arange(upto[-1])].tobytes() if len(ids) else b""


def _model(blob: bytes, kept: dict = {}) -> Pieces:  # noqa: B006
    """The model of these bytes, read once in each worker."""
    if blob not in kept:
        kept.clear()
        kept[blob] = Pieces(blob=blob)
    return kept[blob]


def _encoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = _model(model.value)
    first, last, none = np.array([own.begin], np.int32), np.array([own.end], np.int32), np.zeros(1, np.int64)
    for batch in batches:
        data, offsets = column(batch, "text")
        for lo, hi in pieces(offsets, PIECE_BYTES):
            if len(own.known) > CACHE:
                own.known, own.older = {}, own.known
            known, all_ids, all_ends, sizes = own.known, [], [], [0]
            for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist()):
                seen, at = own.normalise(data[a:b].tobytes().decode("utf-8", "bytewise"))
                segments = own.segment.findall(seen)
                for s in set(segments).difference(known):
                    known[s] = own.older.get(s) or np.array(own.segment_ids(s), np.int32).tobytes()
                ids = np.frombuffer(b"".join(map(known.__getitem__, segments)), np.int32)
                all_ids += [first, ids, last]
                all_ends += [none, at[own.ends(ids)] if len(ids) else none[:0], none + b - a]
                sizes.append(len(ids) + 2)
            bounds = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x), pa.int32())) for x in (all_ids, all_ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], ["doc_id", "ids", "ends"])


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[int]]:
    array = batch.column(name)
    return array.values.to_numpy(), array.offsets.to_pylist()


def _digests(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = _model(model.value)
    told = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        ids, at = _lists(batch, "ids")
        ends, _ = _lists(batch, "ends")
        spans = list(zip(at[:-1], at[1:]))
        columns = [[b - a for a, b in spans], [told(ids[a:b].astype("<u4").tobytes()) for a, b in spans], [told(own.decode(ids[a:b]).encode()) for a, b in spans], [told(ends[a:b].astype("<u4").tobytes()) for a, b in spans]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ends_sha256"])


def _decoded(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = _model(model.value)
    for batch in batches:
        texts = [None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids and ends of every row of docs (doc_id, text): the ids of the whole text, begin and end id included, and the byte of the source's UTF-8 before which each piece ends. A piece begins where the one before ends (the first behind the spaces that a model drops at the start, if it does).

    One pass without a shuffle. Texts fall into segments between which no piece can stand; a Python
    worker remembers those it met last, at most 2 * CACHE and a few texts' more, and encodes again what it forgets. The model is read on the driver and broadcast; its size doesn't grow with the
    data. Null and empty texts have the begin and end id only. Repeated rows and ids keep a row each; an empty table gives an
    empty result; more columns, whatever they are called, are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_encoded, model=_shared(docs, model)), f"doc_id {_kind(docs)}, ids array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids): null for null, empty for no ids."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decoded, model=_shared(encoded, model)), f"doc_id {_kind(encoded)}, text string")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_pieces(table(spark, sf_dir, "documents"))
    return encoded.mapInArrow(partial(_digests, model=_shared(encoded, MODEL)), f"doc_id {_kind(encoded)}, n_tokens long, ids_sha256 string, decoded_sha256 string, ends_sha256 string")
