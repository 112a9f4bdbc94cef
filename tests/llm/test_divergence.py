"""The source audit against its SQL and against a plain sum over all terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import loomlake.llm.divergence as divergence
from loomlake.llm.divergence import OP12_SQL, op12_source_divergence, source_divergence


def brute(rows, least=3, top=200):
    langs = defaultdict(lambda: defaultdict(Counter))
    seen = defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        langs[lang or ""][source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = set()
    for lang, groups in langs.items():
        kept = {t for t, k in seen[lang].items() if k >= least}
        whole = sum(groups.values(), Counter())

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in groups.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found))}
    return out


def made(rng, n):
    words = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "naïve", "日本語", "ABC", "x1y", "_z"]
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "über"])
        yield rng.choice(["en", "de", None]), source, rng.choice([None, "", "12 3!"]) if rng.random() < 0.1 else " ".join(words[min(int(rng.expovariate(0.1)), len(words) - 1)] for _ in range(rng.randrange(1, 40)))


SCHEMA = "lang string, source string, text string, n string, item long"


def test_against_a_sum_over_all_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 5)
    rows = list(made(random.Random(4), 300)) + [("xx", "a", "one"), ("xx", "b", None), ("yy", "only", "w w w"), ("zz", "a", "p q"), ("zz", "b", "p q"), ("zz", "b", "p p"), ("zz", "c", "?")]
    got = source_divergence(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA).repartition(7)).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows)
    assert {(r.source, r.item, r.value) for r in got if r.lang == "xx"} == {("a", "b", 0), ("b", "a", 0)}


def test_steps_of_one_partition(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = list(made(random.Random(5), 80))
        got = source_divergence(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA), top=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == brute(rows, top=5)


def test_large_counts_stay_exact():
    from pyspark.sql import functions as F  # noqa: F401

    import numpy as np
    import pyarrow as pa

    p = np.array([10**9 + 1, 1, 10**9, 7], np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["a", "b", "a", "b"]), pa.array(p), pa.array(np.ones(4, np.int64))], ["lang", "source", "p", "p0"])
    out = pa.Table.from_batches(divergence._corrections(rows, np.array([True, False, True, False]))).to_pylist()
    f = lambda a, b: (a - b) ** 2 // b
    want = lambda x, y: sum(f(x[k], y[k]) - f(x[k], 1) - f(1, y[k]) + f(1, 1) for k in range(2))
    a, b = [int(x) for x in p[::2]], [int(x) for x in p[1::2]]
    assert {(r["source"], r["high"] * 2**32 + r["low"]) for r in out} == {("a", want(a, b)), ("b", want(b, a))}


def test_empty_and_very_long(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "alpha beta " * 200_000
    rows = [("en", "a", text), ("en", "a", "alpha"), ("en", "b", "alpha beta"), ("en", "b", "beta")]
    assert {tuple(r) for r in source_divergence(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA)).collect()} == brute(rows)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_equals_its_sql(spark, size):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('/root/testdata/{size}/documents.parquet')")
    want = con.execute(OP12_SQL).fetchall()
    got = op12_source_divergence(spark, f"/root/testdata/{size}")
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == set(want)
