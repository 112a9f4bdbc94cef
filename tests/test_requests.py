"""Masks, request expressions, reply parsing, limits and made-up rows against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomlake.functions import masking
from loomlake.functions import requests as R
from loomlake.functions import text as T
from loomlake.operators import events, quality, reasoning, tiering
from loomlake.sources import samples


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("4111111111111111", "************1111"),
        ("pay 4111-1111 1111-1111 now 378282246310005", "pay ************1111 now ***********0005"),
        ("12345678901234567890", "12345678901234567890"),
        ("", ""),
        (None, None),
    ],
)
def test_cards(spark, text, want):
    assert one(spark, T.mask_cards(F.col("text")), text) == want


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("phone", "tel 13812345678", "tel 138****5678"),
        ("phone", "none", "***PHONE***"),
        ("id_card", "110101199003071234", "110101********1234"),
        ("id_card", "110101900307123", "110101*****7123"),
        ("email", "anna@x.org", "a**a@x.org"),
        ("email", "ab@x.org", "a*@x.org"),
        ("card", "4111 1111 1111 1111", "**** **** **** 1111"),
        ("card", "378282246310005", "***********0005"),
        ("card", "12", "***CARD***"),
        ("password", "", "***"),
        ("email", None, None),
    ],
)
def test_fields(spark, kind, text, want):
    assert one(spark, masking.mask_field(kind, F.col("text")), text) == want


def test_nested(spark):
    schema = "user struct<email: string, tokens: array<string>, pin_password: int>, notes map<string, string>, n int"
    rows = spark.createDataFrame([((("anna@x.org", ["a", None], 7)), {"a": "tel 13812345678"}, 1), (None, None, None)], schema)
    first, second = masking.mask_rows(rows).collect()
    assert first.user.asDict() == {"email": "a**a@x.org", "tokens": ["***TOKEN***", None], "pin_password": None}
    assert first.notes == {"a": "tel 138****5678"} and first.n == 1
    assert second.asDict() == {"user": None, "notes": None, "n": None}


def test_json(spark):
    mask = masking.mask_json(F.col("text"), "password string, xs array<struct<phone: string>>")
    assert one(spark, mask, '{"password": "p", "xs": [{"phone": "13812345678"}]}') == '{"password":"***","xs":[{"phone":"138****5678"}]}'
    assert one(spark, mask, None) is None


@pytest.mark.parametrize(("name", "want"), [("../a b?.txt", "a b_.txt"), ("气 功/é.md", "气 功é.md"), ("...", "unnamed"), ("", "unnamed"), (None, "unnamed")])
def test_safe_filename(spark, name, want):
    assert one(spark, R.safe_filename(F.col("text")), name) == want


@pytest.mark.parametrize(
    ("name", "size", "want"),
    [("", 1, "Empty filename"), (None, 1, "Empty filename"), ("a.exe", 1, "File extension '.exe' not allowed"), (".txt", 1, "File extension '' not allowed"), ("A.TXT", None, "Upload validation passed"), ("a.txt", 3 << 20, "File size 3.00MB exceeds maximum 2.00MB")],
)
def test_upload(spark, name, size, want):
    row = spark.createDataFrame([(name, size)], "name string, size long")
    assert row.select(R.upload_verdict(F.col("name"), F.col("size"), {".txt"}, 2 << 20)).first()[0] == want


@pytest.mark.parametrize(
    ("reply", "steps", "answer"),
    [
        ("思考过程：\n so\n1. one\nmore\n2. two\n4. four\n答案： yes \n", ["1. one\nmore", "2. two\n4. four"], "yes"),
        ("思考过程:\n1. one", ["1. one"], ""),
        ("思考过程:\nnone\n答案:x", ["思考过程:\nnone\n答案:x"], "x"),
        ("plain" * 200, ["plain" * 100], "plain" * 200),
        (None, [""], ""),
    ],
)
def test_reply(spark, reply, steps, answer):
    found = one(spark, reasoning.thought_and_answer(F.col("text")), reply)
    assert (found.steps, found.answer) == (steps, answer)


def test_tips(spark):
    assert one(spark, reasoning.practice_tips(F.col("text"), 2), "先站好。注意呼吸。技巧在慢！要放松。") == ["注意呼吸。", "技巧在慢！"]


def test_limits(spark):
    rows = [(i, i * events.MICROS, "a" if i < 3 else None) for i in range(5)]
    frame = spark.createDataFrame(rows, "id int, micros long, ip string")
    found = events.limits(frame, {"ip": (F.col("ip"), 2, 10), "all": (F.lit(1), 4, 10)})
    assert [(r.allowed, r.remaining, r.denied_by) for r in found.orderBy("id").collect()] == [(True, 1, None), (True, 0, None), (False, 0, "ip"), (True, 0, None), (False, 0, "all")]


def test_retention(spark):
    day = lambda n: datetime.datetime(2024, 12, 31) - datetime.timedelta(days=n)
    rows = spark.createDataFrame([(n, day(n)) for n in (0, 2, 8, 31, 400)] + [(9, None)], "n int, t timestamp_ntz")
    found = {r.n: (r.age_class, r.expired) for r in tiering.retention(rows, "t", F.lit(day(0))).collect()}
    assert found == {0: (None, False), 2: ("daily", False), 8: ("weekly", True), 31: ("monthly", False), 400: ("yearly", True), 9: (None, False)}


def test_worst_status_and_grade(spark):
    rows = spark.createDataFrame([(1, "healthy"), (1, "degraded"), (2, None), (3, "unhealthy"), (3, "healthy")], "k int, s string")
    assert {r.k: r.status for r in quality.worst_status(rows, ["k"], "s").collect()} == {1: "degraded", 2: "unknown", 3: "unhealthy"}
    scores = spark.createDataFrame([(0, 0, 0), (1, 2, 1), (2, 9, 3)], "a int, b int, c int")
    points = quality.security_points(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in scores.select(points, quality.grade(points)).collect()] == [(100, "A"), (60, "D"), (5, "F")]


def test_sample_chunks(spark):
    docs = spark.createDataFrame([(k, "abc" * 900) for k in range(5)] + [(8, ""), (9, None)], "doc_id long, text string")
    for k, group in samples.sample_chunks(docs).toPandas().groupby("doc_id"):
        parts = group.sort_values("chunk_index")
        size = len(parts.content.iloc[0])
        assert k < 5 and 500 <= size <= 2000
        assert all(("abc" * 900)[p : p + size] == c for p, c in zip(parts.position, parts.content))
        assert set(parts.position.diff().dropna()) <= {size - size // 10}
