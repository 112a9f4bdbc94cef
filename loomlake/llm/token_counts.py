"""Token counts by a unigram model whose forward scores are shared along a trie of the distinct words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import column, pieces, word_names, word_spans
from .common import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES = 1 << 21
CACHE = 400_000  # words a task remembers
SPACE = "▁".encode()  # stands before every word


def unigram_scores(path: str = VOCABULARY) -> tuple[dict[bytes, float], float]:
    """Log-probability by piece (UTF-8), and that of a single byte outside the pieces.

    The public vocabulary file ranks its pieces but holds no probabilities, so they follow the rank by Zipf's law. A byte
    that no piece covers counts as one token, less likely than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return {model.id_to_piece(i).encode(): -math.log(k + 1) - total for k, i in enumerate(ids)}, -math.log(len(ids) + 1) - total - 10


def piece_endings(scores: dict[bytes, float]) -> dict[bytes, float | None]:
    """Score by piece, and None for what is only the ending of pieces."""
    return {p[k:]: None for p in scores for k in range(1, len(p))} | scores


def count_words(words: list[bytes], endings: dict[bytes, float | None], single: float) -> list[int]:
    """Tokens of the best segmentation of each word; `words` are sorted and distinct.

    Sorted words are the depth-first walk of their trie. The forward scores of the current path are kept on a stack; the
    part that a word shares with the one before is not computed again. A terminal's count is that of its last position.
    Of equally good segmentations the one with fewer tokens counts. At each place pieces are tried from the shortest on,
    until what stands there is no piece's ending any more. endings: see piece_endings.
    """
    best, count, before, out = [0.0], [0], b"", []
    get, other = endings.get, object()
    for word in words:
        at, most = 0, min(len(word), len(before))
        if word[:most] == before[:most]:
            at = most
        else:
            while word[at] == before[at]:
                at += 1
        del best[at + 1 :], count[at + 1 :]
        for end in range(at + 1, len(word) + 1):
            top, n = best[end - 1] + single, count[end - 1] + 1
            for start in range(end - 1, -1, -1):
                score = get(word[start:end], other)
                if score is other:
                    break
                if score is not None:
                    score += best[start]
                    if score > top or score == top and count[start] + 1 < n:
                        top, n = score, count[start] + 1
            best.append(top)
            count.append(n)
        before = word
        out.append(count[len(word)])
    return out


def _counted(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    scores, single = vocabulary.value
    endings = piece_endings(scores)
    known: dict[bytes, int] = {}
    for batch in batches:
        data, offsets = column(batch, "text")
        for lo, hi in pieces(offsets, PIECE_BYTES):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo])
            which, first = word_names(part, starts, ends)
            raw = part.tobytes()
            distinct = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
            if len(known) > CACHE:
                known = {}
            new = sorted(SPACE + w for w in distinct if w not in known)
            fresh = dict(zip(new, count_words(new, endings, single)))
            known.update((w[len(SPACE) :], n) for w, n in fresh.items())
            sums = np.concatenate([[0], np.cumsum(np.array([known[w] for w in distinct], np.int64)[which])]) if len(distinct) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]])], ["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of docs (doc_id, text), in one pass without a shuffle.

    A pre-token is a word with the space mark before it. Null, empty and blank texts have 0. Repeated rows and ids keep a
    row each; an empty table gives an empty result; more columns are ignored. A task remembers up to CACHE words; what it
    forgets is computed again. The vocabulary is read on the driver and broadcast; its size doesn't grow with the data.
    """
    from functools import partial

    held = docs.sparkSession.sparkContext.broadcast(unigram_scores(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_counted, vocabulary=held), f"doc_id {kind}, n_words long, n_tokens long")


def op9_trie_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
