"""Masks of the leaks once found, indexes, folds by stretches, import helpers and checks that no query shows."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import masking, text as T
from loomlake.operators import answers as A
from loomlake.operators import events as E
from loomlake.operators import reports as R
from loomlake.operators import retrieval
from loomlake.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "said, shown",
    [
        ('{"password": "hunter22"}', '{"password": "***"}'),
        ("password='open sesame' x", "password=*** x"),
        ("use sk_live_abcdefghijklmnopqrstuvwx now", "use sk_l***uvwx now"),
        ("no 110101900307123 there", "no 110101*****7123 there"),
        ("+86 13812345678 or 138-1234-5678", "+86 138****5678 or 138****5678"),
        ("Bearer abc.def", "Bearer ***TOKEN***"),
        ("a@x.com and ba@x.com and someone@x.com", "*@x.com and **@x.com and s*****e@x.com"),
        ("mysql --password=secret -p hunter", "mysql --password=*** -p ***"),
        ("https://h/?a=1&password=abc", "https://h/?a=1&password=***"),
        (None, None),
    ],
)
def test_sensitive_text(spark, said, shown):
    assert one(spark, T.mask_sensitive(F.lit(said).cast("string"))) == shown


def test_sensitive_names(spark):
    for name in ("private_key", "authorization", "bearer_x", "cell", "api-key"):
        assert one(spark, masking.mask_field(masking.field_kind(name), F.lit("v"))) == "***REDACTED***"


def test_folds_by_stretches_change_nothing(spark):
    rows = spark.createDataFrame([(k, i, t * 1_000_000) for k in (1, None) for i, t in enumerate((0, 1, 2, 3, 40, 41, 55, 56, 57, 300, 301))], "k long, i long, t long")
    got = [sorted(E.ordered_fold(rows, "k", "t", "i", E.sliding_window(2, 10, False), [], "a", "boolean", gap=gap).collect(), key=str) for gap in (None, 10)]
    assert got[0] == got[1] and len(got[0]) == 22


def test_windows_over_all_keys(spark):
    rows = spark.createDataFrame([(t * 1_000_000, "sql", ip) for t, ip in ((0, "b"), (300, "a"), (599, "a"), (1200, "b"), (5000, None))], "micros long, kind string, ip string")
    r = R.attack_windows(rows, {"sql": 3}, "kind", "ip").first()
    assert (r.alerts, r.worst, r.top_ip) == (1, 3, "a")


def test_imports(spark):
    rows = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("b", "t2", 3), ("b", "t3", 4), ("b", "t4", 5)], "category string, title string, order long")
    there = spark.createDataFrame([("t1",)], "title string")
    got = {r.category: (r.seen, r.imported, r.skipped) for r in R.import_counts(rows, there, "category").collect()}
    assert got == {"a": (2, 1, 1), "b": (3, 2, 1)}
    assert {r.category: r.seen for r in R.import_counts(rows, there, "category", limit=2).collect()} == {"a": 2, "b": 2}
    assert [r.error for r in R.bad_rows(rows, {"late": F.col("order") > 2}, "order", 2).collect()] == ["late", "late"]


def test_keys_and_requests(spark):
    assert one(spark, R.cache_key_parts(F.lit("other:a:b:c:v1"))) is None
    assert one(spark, R.glob_match(F.lit("user:1.x"), "user:?.*")) and not one(spark, R.glob_match(F.lit("user:11.x"), "user:?.*"))
    assert one(spark, R.cacheable(F.lit("/any"), F.lit("GET"))) and not one(spark, R.cacheable(F.lit("/any"), F.lit("POST")))
    R.check_arguments(k=(5, 1, 50), question=("abc", 1, 10))
    with pytest.raises(ValueError, match="k must"):
        R.check_arguments(k=(0, 1, 50))


def test_checksum_sees_contents_and_schema(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    sums = [R.content_checksum(df).first().checksum for df in (a, a.orderBy(F.desc("k")), a.withColumn("v", F.upper("v")), a.withColumnRenamed("v", "w"), a.limit(0))]
    assert sums[0] == sums[1] and len(set(sums)) == 4


def test_reply_without_rows_and_tools(spark):
    empty = F.array().cast("array<struct<title:string,text:string>>")
    assert one(spark, A.reply(empty)) == A.NOT_FOUND and one(spark, A.search_tool(empty, "x")) == "无可用上下文"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "one", "content": "c"}, {"title": "two"}]')
    (tmp_path / "b.json").write_text('{"title": "three", "content": "d"}')
    (tmp_path / "bad.json").write_text("{nothing")
    rows, bad = tables.read_json_folder(spark, str(tmp_path))
    assert {r.title for r in rows.collect()} == {"one", "two", "three"} and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]
    assert len(tables.list_files(spark, str(tmp_path), "*.json", most=2).collect()) == 2
    assert {len(r.sha512) for r in tables.file_hashes(spark, str(tmp_path), "*.json").collect()} == {128}
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path), "orders")


def test_recall_of_the_vector_index(spark):
    from loomlake.plans import registry

    sf = "/root/testdata/sf0.1"
    found, exact = ({(r.query, r.vec_id) for r in registry.QUERIES[q](spark, sf).collect()} for q in ("vector_index_search", "vector_search_set"))
    assert len(found & exact) >= 0.9 * len(exact) and exact


def test_written_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "category string, n int")
    tables.write_by_category(rows, str(tmp_path / "c"))
    assert {(r.category, r.rows) for r in spark.read.json(str(tmp_path / "c_stats")).collect()} == {("a", 2), ("b", 1)}
    assert spark.read.json(str(tmp_path / "c")).count() == 3
    for kind in ("json", "csv"):
        tables.write_report(rows, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        tables.write_report(rows, str(tmp_path / "x"), "pdf")
