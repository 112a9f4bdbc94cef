"""The quantised index against exact search."""

import numpy as np
import pyarrow as pa
import pytest

from loomlake.operators import vectors as V
from loomlake.operators.vectors import nearest_of_each


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 18)) * 3
    return [*(centres[rng.integers(30)] + rng.normal(size=18) for _ in range(2000)), None, np.zeros(18)]


def test_recall_at_a_fifth_of_the_codes(spark, clustered, tmp_path):
    df, path = frame(spark, clustered), str(tmp_path / "i")
    V.build(df, path)
    asked = df.where("vec_id % 50 = 0")
    found = V.search(df, path, asked, 10, share=0.15, shortlist=60).collect()
    exact = nearest_of_each(df.where("vec_id != 2001"), asked, 10).collect()
    pairs, want = {(r["query"], r.vec_id) for r in found}, {(r["query"], r.vec_id) for r in exact}
    assert len(pairs & want) >= 0.9 * len(want) and len(found) == len(want)
    near = {(r["query"], r.vec_id): r.similarity for r in exact}
    assert all(abs(near[p] - r.similarity) < 1e-6 for r in found if (p := (r["query"], r.vec_id)) in near)
    lists = spark.read.parquet(f"{path}/codes")
    assert lists.select("list").distinct().count() > 30 and lists.selectExpr("sum(size(keys))").first()[0] == 2001
    read = lists.selectExpr("list", "size(keys) n").toPandas().groupby("list").n.sum()
    assert read.sort_values(ascending=False).head(round(0.15 * 45)).sum() < 0.4 * 2001


def test_all_lists_and_a_long_shortlist_are_exact(spark, clustered, tmp_path):
    df, path = frame(spark, clustered[:300]), str(tmp_path / "i")
    V.build(df, path, lists=5)
    asked = df.where("vec_id < 20")
    found, exact = V.search(df, path, asked, 7, share=1.0, shortlist=300), nearest_of_each(df, asked, 7)
    zeros = frame(spark, [np.ones(4), np.zeros(4), -np.ones(4)])
    V.build(zeros, str(tmp_path / "z"))
    assert {r.vec_id for r in V.search(zeros, str(tmp_path / "z"), zeros.where("vec_id = 0"), 3, share=1.0, shortlist=5).collect()} == {2}
    key = lambda x: {(r["query"], r.vec_id, round(r.similarity, 9)) for r in x.collect()}
    assert key(found) == key(exact)


def test_empty(spark, tmp_path):
    df, path = frame(spark, [None]), str(tmp_path / "i")
    V.build(df, path)
    assert V.search(df, path, df, 3, share=1.0, shortlist=5).count() == 0


def test_no_more_leaves_a_task_than_the_shortlists(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres, books, n, most = rng.normal(size=(3, 8)), rng.normal(size=(2, V.CODES, V.WIDTH)), 300, 20
    qs = rng.normal(size=(50, 8)) / 3
    blocks = [(i % 3, np.arange(i * n, (i + 1) * n), rng.integers(0, 6, size=(n, 2)).astype(np.uint8)) for i in range(40)]  # few codes, so estimates tie
    lists = V._Shortlists(pa.array(range(50)), qs.tobytes(), centres, books, 0.67, most)
    for at, keys, codes in blocks:
        lists.add(at, pa.array(keys), codes.tobytes())
        assert lists.n <= 4 * most * 50
    got = {}
    for batch in lists.rows():
        for r in batch.to_pylist():
            got.setdefault(r["query"], []).append(r["key"])
    for i, q in enumerate(qs):
        read = np.argsort(-(centres @ q), kind="stable")[:2]
        rows = [(-round(float(q @ (centres[at] + books[[0, 1], c].ravel())), 12), int(key)) for at, keys, codes in blocks if at in read for key, c in zip(keys, codes)]
        assert got[i] == [key for _, key in sorted(rows)[:most]]


def test_equal_vectors_are_shortlisted_by_key(spark, tmp_path):
    df, path = frame(spark, [np.arange(1, 9)] * 3000), str(tmp_path / "i")
    V.build(df, path, lists=2)
    found = V.search(df, path, df.where("vec_id in (7, 2900)"), 5, share=1.0, shortlist=6).collect()
    assert {(r["query"], r.vec_id) for r in found} == {(7, i) for i in range(5)} | {(2900, i) for i in range(5)}
