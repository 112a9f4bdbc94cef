"""Readers and writers that no registered query covers."""

from loomlake.sources import tables as S


def test_sections_of_a_json_file(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text('{"users": [{"username": "a", "age": 3}, {"username": "b", "age": null}], "documents": []}')
    assert [(r.username, r.age) for r in S.read_json_section(spark, str(path), "users").orderBy("username").collect()] == [("a", 3), ("b", None)]
    assert S.read_json_section(spark, str(path), "nothing").count() == 0


def test_csv_comes_as_text(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('username,email\n007,"x,y@example.com"\nb,\n')
    rows = S.read_csv(spark, str(path), "users")
    assert [t for _, t in rows.dtypes] == ["string", "string"] and [tuple(r) for r in rows.orderBy("username").collect()] == [("007", "x,y@example.com"), ("b", None)]


def test_appended_rows_stay_beside_those_before(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(2):
        S.append(spark.createDataFrame([(i, "a"), (i, "b")], "n long, category string"), path, ["category"])
    assert spark.read.parquet(path).where("category = 'a'").count() == 2 and spark.read.parquet(path).count() == 4
    S.append(spark.range(3), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 3


def test_records_of_each_kind(spark):
    raw = spark.createDataFrame([("a", "a@x", "false", "2024-05-01T10:00:00"), (None, None, None, None), ("c", "c@x", "maybe", "yesterday"), ("d", "d@x", None, "")], "username string, email string, is_active string, last_login string")
    rows, errors = S.import_records(raw, "users")
    got = {r.email: (r.username, r.password_hash, r.is_active, r.is_admin, str(r.last_login)) for r in rows.collect()}
    assert got["a@x"] == ("a", "placeholder_hash", False, False, "2024-05-01 10:00:00") and got["d@x"] == ("d", "placeholder_hash", True, False, "None")
    assert got[None][0].startswith("imported_") and [(r.username, r.fields) for r in errors.collect()] == [("c", ["is_active", "last_login"])]
    one = S.import_records(spark.createDataFrame([("t",)], "title string"), "documents")[0].first()
    assert (one.title, one.content, one.extension, one.uploader_id, one.file_size) == ("t", "", ".txt", 1, 0)
    assert S.import_records(raw.limit(0), "users")[0].count() == 0


def test_tables_of_a_folder(spark):
    assert S.tables_of(spark, "/root/testdata/sf0.001") == sorted("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def test_an_html_report_is_one_table(spark, tmp_path):
    rows = spark.createDataFrame([("a<b>", 1), (None, 2)], "name string, `n of rows` long").repartition(3)
    S.write_report(rows, str(tmp_path / "r"), "html")
    lines = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert lines == ["<table>", "<tr><th>name</th><th>n of rows</th></tr>", "<tr><td></td><td>2</td></tr>", "<tr><td>a&lt;b&gt;</td><td>1</td></tr>", "</table>"]


def test_files_of_a_tier(spark, tmp_path):
    for tier in ("hot", "cold"):
        (tmp_path / tier).mkdir()
        (tmp_path / tier / f"{tier}.txt").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in S.list_files(spark, str(tmp_path), tier="cold").collect()] == ["cold.txt"]
