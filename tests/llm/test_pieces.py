"""Encoding, spans and decoding against the public library."""

import hashlib
import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from loomlake.llm.pieces import MODEL, Pieces, decode_pieces, encode_pieces, op11_sentence_pieces

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "   x  y ", "a\x00b", "<s> hi </s><0x0A><unk>", "▁x ▁▁ y▁", "ﬁ Å １ ﬃ", "é é  　x​z﻿", "日本 ☃🙂👩‍👩‍👧", "\n\n\t\r\n", "x" * 500, "ab" * 300 + " " * 70 + "c",
    "١٢٣ 123 4.5", "ｶﾞｷﾞ ㌔㍿", "\U0001f1e9\U0001f1ea\x7f\x85", " ▁", "Übergrößenträger naïve façade", "a b",
]


def strings(seed, n):
    rng = random.Random(seed)
    alphabet = "abcdeth  ▁\n\t.é日1９ﬁ　́🙂Å①"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def changed(**spec):
    """The model with the public character map of a rule, or other switches."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    if rule := spec.pop("rule", None):
        source = sentencepiece_model_pb2.ModelProto()
        source.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = source.normalizer_spec.precompiled_charsmap
    for k, v in spec.items():
        setattr(model.normalizer_spec, k, v)
    return model.SerializeToString()


@pytest.mark.parametrize("spec", [{}, {"rule": "nmt_nfkc"}, {"rule": "nfkc_cf"}, {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}])
def test_equals_the_library(spec):
    blob = changed(**spec)
    own, library = Pieces(blob=blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in ODD + strings(1, 800):
        got = own.encode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert [g[0] for g in got] == want, text
        assert own.decode(want) == library.decode(want), text
        if not spec.get("remove_extra_whitespaces"):
            assert [g[1] for g in got[1:]] == [g[2] for g in got[:-1]] and got[-1][2] == len(text.encode())


def test_spans_are_those_of_the_library():
    for spec in ({}, {"rule": "nmt_nfkc"}, {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}):
        blob = changed(**spec)
        own, library = Pieces(blob=blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
        for text in ODD + strings(2, 300):
            found = library.encode(text, return_type="proto")
            assert own.encode(text)[1:-1] == [(p.id, p.begin, p.end) for p in found.pieces], text


def test_pieces_spell_their_spans():
    own = Pieces()
    for text in strings(3, 200):
        data = text.encode()
        for i, b, e in own.encode(text):
            if e > b and own.kinds[i] == 1:
                assert own.names[i].replace("▁", " ").encode().strip() == data[b:e].decode().replace("▁", " ").encode().strip()


def test_any_ids_decode_as_in_the_library():
    own, library, rng = Pieces(), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(0, 3), rng.randrange(3, 259), rng.randrange(259, 32000), 28705]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_rows(spark):
    data = [(1, "Hello  world", 3), (2, None, 3), (3, "", 3), (4, "x", 3), (4, "x", 3), (None, "日本 ☃", 3)]
    encoded = encode_pieces(spark.createDataFrame(data, "doc_id long, text string, ids int"))
    rows = {r.doc_id: (r.ids, r.ends) for r in encoded.collect()}
    assert encoded.count() == 6 and rows[2] == rows[3] == ([1, 2], [0, 0]) and rows[1] == ([1, 22557, 28705, 1526, 2], [0, 5, 6, 12, 12])
    assert {r.doc_id: r.text for r in decode_pieces(encoded).collect()} == {k: t or "" for k, t, _ in data}
    assert encode_pieces(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert decode_pieces(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]


def test_very_long_texts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijk") for _ in range(200_000)), "word and " * 100_000, " " * 50_000]
    rows = encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_bos=True, add_eos=True) and r.ends[-1] == len(texts[r.doc_id])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, size):
    folder = f"/root/testdata/{size}"
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    told = lambda data: hashlib.sha256(data).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.add((r.doc_id, len(ids), told(b"".join(i.to_bytes(4, "little") for i in ids)), told(library.decode(ids).encode())))
    rows = op11_sentence_pieces(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
