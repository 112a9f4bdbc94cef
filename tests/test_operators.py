"""Operators against golden values calculated by hand."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import events, graph, metrics, quality, ranks, retrieval, routing
from loomlake.plans import documents
from loomlake.sources import tables


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"text {kind}").select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("text")), "八段锦 Héllo, foo_bar! a x²") == ["八段锦", "héllo", "foo_bar", "x²"]
    assert one(spark, T.tokens(F.col("text")), None) == []


@pytest.mark.parametrize(
    ("query", "want"),
    [("breath posture", {3: 1.274372, 1: 1.026043}), ("breath breath", {1: 1.20344, 3: 1.106825}), ("ginseng", {2: 0.940336}), ("", {}), ("absent", {})],
)
def test_bm25(spark, query, want):
    docs = spark.createDataFrame(
        [(1, "qigong basics breath and posture and calm breath"), (2, "herb notes ginseng root and herb tea"), (3, "posture guide posture, breath")], "doc_id long, text string"
    )
    assert {r.doc_id: round(r.score, 6) for r in retrieval.bm25(docs, query.split()).collect()} == want


def test_hash_embedding(spark):
    e = one(spark, T.hash_embedding(F.col("text"), 1024), "abc")
    assert len(e) == 1024
    e = one(spark, T.hash_embedding(F.col("text")), "abc")
    assert sum(x * x for x in e) == pytest.approx(1)
    cos = one(spark, T.cosine(T.hash_embedding(F.lit("abc")), T.hash_embedding(F.lit("abd"))))
    assert round(cos, 6) == -0.007277


def test_fusion(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, similarity double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    assert [(r.id, round(r.score, 6)) for r in retrieval.fuse(v, b, 5).collect()] == [(2, 0.016503), (1, 0.01), (3, 0.006557)]


def test_floor_percentile(spark):
    rows = spark.createDataFrame([("k", float(x)) for x in range(1, 11)], "k string, v double")
    asked = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    for keys in ([], ["k"]):
        r = ranks.floor_percentiles(rows, keys, "v", asked).first()
        assert (r.p50, r.p90, r.p95, r.p99) == (5, 9, 9, 9)
    assert ranks.floor_percentiles(rows, ["k"], "v", {"p": 0.95}, offset=0).first().p == 10


def test_entities_and_pairs(spark):
    docs = spark.createDataFrame([(1, "八段锦与站桩可调气血，\n养心益肾。")], "doc_id long, text string")
    found = graph.entities(docs)
    assert [(r.name, r.type) for r in found.orderBy("ordinal").collect()] == [("八段锦", "功法"), ("气", "概念"), ("站桩", "动作"), ("心", "脏腑"), ("肾", "脏腑")]
    pairs = {(r.source, r.target) for r in graph.cooccurrences(docs).collect()}
    assert pairs == {("八段锦", "气"), ("八段锦", "站桩"), ("气", "站桩"), ("心", "肾")}


def test_graph_of_all_rows(spark):
    sf = "/root/testdata/sf0.001"
    edges = {(f"s{r[0]}", f"p{r[1]}") for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    links = {}
    for s, t in edges:
        links.setdefault(s, set()).add(t)
        links.setdefault(t, set()).add(s)
    run = lambda name: [tuple(r) for r in documents.QUERIES[name](spark, sf).collect()]
    assert sorted(run("graph_neighbors_whole")) == sorted((v,) for v in links["s5"])
    hops = {"s5": 0}
    for depth in (1, 2, 3):
        hops |= {w: depth for v in list(hops) for w in links[v] if w not in hops}
    assert sorted(run("graph_path_whole")) == sorted(hops.items())
    near = {"s5", "s6"} | links["s5"] | links["s6"]
    subgraph = documents.QUERIES["graph_subgraph_whole"](spark, sf).select("source", "target").collect()
    assert sorted(map(tuple, subgraph)) == sorted((s, t) for s, t in edges if s in near and t in near)


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "source string, target string")
    got = {r["name"]: (r.hops, r.path) for r in graph.shortest_paths(edges, "a", 3).collect()}
    assert got["d"] == (3, ["a", "b", "c", "d"]) and "e" not in got and "x" not in got and got["a"] == (0, ["a"])
    assert graph.shortest_paths(edges, "unknown").count() == 0


def test_routing(spark):
    for q, want in (("八段锦第一式怎么做？", "qigong"), ("中医怎么把脉？", "tcm"), ("孔子的仁政思想是什么？", "confucian"), ("今天天气怎么样", "general")):
        assert one(spark, routing.gateway_domain(F.col("text")), q) == want
    assert one(spark, routing.context_of(F.array().cast("array<struct<a:int,title:string,text:string>>"))) == "无相关上下文"


def test_chunks_and_masks(spark):
    assert [(c.position, len(c.chunk)) for c in one(spark, T.chunks(F.col("text")), "x" * 1000)] == [(0, 512), (462, 512), (924, 76)]
    mask = T.mask_sensitive(F.col("text"))
    assert one(spark, mask, "tel 13812345678") == "tel 138****5678"
    assert one(spark, mask, "id 110101199003071234") == "id 110101199****71234"
    assert one(spark, mask, "write to johndoe@example.org, ab@x.io") == "write to j*****e@example.org, **@x.io"
    assert one(spark, mask, "password: hunter2 x") == "password=*** x"


def test_orphans_leave_null_keys_out(spark):
    child = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    assert [r.k for r in quality.orphans(child, "k", parent, "id").collect()] == [3]


ARRIVALS = [0, 1, 2, 3, 4, 10, 11, 11.5, 12, 13]


@pytest.mark.parametrize(
    ("machine", "want"),
    [
        (events.sliding_window(3, 10, False), "1110011010"),
        (events.sliding_window(3, 10, True), "1110001101"),
        (events.token_bucket(6.0, 0.3), "1111111110"),
        (events.token_bucket(3.0, 0.3), "1110111000"),
        (events.fixed_window(3, 10), "1110011100"),
    ],
)
def test_limiters(spark, machine, want):
    rows = spark.createDataFrame([(k, i, int(t * events.MICROS)) for k in ("a", "b", None) for i, t in enumerate(ARRIVALS)], "k string, i long, t long")
    got = events.ordered_fold(rows, "k", "t", "i", machine, [], "ok", "boolean").orderBy("k", "i").collect()
    assert "".join(str(int(r.ok)) for r in got) == want * 3


def test_redis_limiter_counts_denied_requests(spark):
    rows = spark.createDataFrame([("a", int(t * events.MICROS)) for t in ARRIVALS], "k string, micros long")
    got = events.trailing_count(rows, ["k"], 10, "n").orderBy("micros").collect()
    assert "".join(str(int(r.n <= 3)) for r in got) == "1110000000"


def test_breaker(spark):
    rows = spark.createDataFrame([("a", i, i * events.MICROS, False) for i in range(4)] + [("a", 9, 100 * events.MICROS, True), ("a", 10, 101 * events.MICROS, True)], "k string, i long, t long, ok boolean")
    got = events.ordered_fold(rows, "k", "t", "i", events.circuit_breaker(3, 60, 2), ["ok"], "state", "string").orderBy("i").collect()
    assert [r.state for r in got] == ["closed", "closed", "open", "rejected", "half_open", "closed"]


def test_import_fields(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"title": "t", "content": "c", "tags": ["x"]}, {"name": "n", "description": "d"}, {"title": "blank", "content": " "}]}')
    rows = tables.import_fields(tables.read_json_documents(spark, str(tmp_path / "a.json")), F.lit("气功")).orderBy("title").collect()
    assert [(r.title, r.content, r.tags) for r in rows] == [("n", "d", ["气功"]), ("t", "c", ["x", "气功"])]
    assert [r.length for r in tables.list_files(spark, str(tmp_path), "*.json").collect()] == [(tmp_path / "a.json").stat().st_size]


def test_size_label(spark):
    assert [one(spark, T.size_label(F.lit(n))) for n in (5, 2048, 3 * 1024**3)] == ["5.00 B", "2.00 KB", "3.00 GB"]
