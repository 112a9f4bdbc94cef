"""Readers and writers: Parquet tables, JSON and CSV imports, file listings, keyed sections and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables_of(spark: SparkSession, folder: str) -> list[str]:
    """Names of the Parquet tables of a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in files)
    return [n.removesuffix(".parquet") for n in names if n.endswith(".parquet")]


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file that is a list, one object, or an object with the list under `data`; a file that can't be parsed has none."""
    raw = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    if "data" in raw.columns:
        return raw.select(F.explode("data").alias("row")).select("row.*")
    return raw


def read_json_section(spark: SparkSession, path: str, section: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode(section).alias("row")).select("row.*") if section in raw.columns else spark.createDataFrame([], "value string").limit(0)


def read_json_folder(spark: SparkSession, folder: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): title, content, category, tags, source_file of every readable file that matches, and the path and error of the others.

    A file is a list of objects or one object. Nothing vanishes: what can't be parsed is in the log of bad files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("content").cast("string").alias("text"))
    row = "struct<title:string,content:string,category:string,tags:array<string>>"
    listed = F.when(F.startswith(F.ltrim("text"), F.lit("[")), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    parsed = files.withColumn("rows", F.from_json(listed, f"array<{row}>", {"mode": "PERMISSIVE"}))
    bad = parsed.where("rows is null or exists(rows, r -> r is null) or (size(rows) > 0 and forall(rows, r -> r.title is null and r.content is null))").select("path", F.lit("not a JSON document").alias("error"))
    rows = parsed.join(bad.select("path"), "path", "left_anti").select(F.col("path").alias("source_file"), F.inline("rows"))
    return rows, bad


def read_csv(spark: SparkSession, path: str, data_type: str = "users") -> DataFrame:
    """CSV with a header; every column is a string. Only users and search_history come as CSV."""
    if data_type not in ("users", "search_history"):
        raise ValueError(f"no CSV import of {data_type}")
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, most: int | None = None, tier: str | None = None) -> DataFrame:
    """path, length and modification time of the files, without reading them; the first `most` by path where it is given.

    Files lie in a folder for each tier where `tier` is given, and only those of one are listed.
    """
    folder = folder if tier is None else f"{folder}/{tier}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder).select("path", "length", "modificationTime")
    return found if most is None else found.orderBy("path").limit(most)


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", "modificationTime", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"))


def import_fields(row: DataFrame, category: Column, keep: tuple = ()) -> DataFrame:
    """title, content, category and tags with their fallbacks, and the columns of `keep`; rows without content are left out."""
    has = lambda c: F.col(c) if c in row.columns else F.lit(None).cast("string")
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in row.columns else F.array().cast("array<string>")
    return (
        row.withColumn("_category", category)
        .withColumn("title", F.substring(F.coalesce(has("title"), has("name"), F.lit("无标题")), 1, 500))
        .withColumn("content", F.coalesce(has("content"), has("description"), has("正文")))
        .where(F.trim("content") != "")
        .withColumn("tags", F.when(F.array_contains(tags, F.col("_category")), tags).otherwise(F.array_append(tags, F.col("_category"))))
        .select(*keep, "title", "content", F.col("_category").alias("category"), "tags")
    )


# The fields of imported records, their types and what stands for a missing one.
RECORDS = {
    "users": {"username": ("string", None), "email": ("string", None), "password_hash": ("string", "placeholder_hash"), "full_name": ("string", None), "is_active": ("boolean", True), "is_admin": ("boolean", False), "last_login": ("timestamp", None)},
    "documents": {"title": ("string", "Imported Document"), "content": ("string", ""), "file_type": ("string", "text/plain"), "extension": ("string", ".txt"), "uploader_id": ("long", 1), "file_path": ("string", ""), "file_size": ("long", 0)},
    "search_history": {"user_id": ("long", 1), "query": ("string", ""), "search_type": ("string", "keyword"), "results_count": ("long", 0), "response_time_ms": ("double", 0.0), "created_at": ("timestamp", None)},
}


def import_records(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of raw records: the fields of a kind in their types, what is missing by its default; a record with a field that can't be read as its type is among the errors, as it came, with the names of those fields.

    A user without a name is called imported_ and a digest of its record. Dates are ISO 8601; an empty one is none. Fields
    of raw that the kind doesn't have are left out.
    """
    fields = RECORDS[kind]
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    given = {c: F.nullif(has(c).cast("string"), F.lit("")) if t == "timestamp" else has(c) for c, (t, _) in fields.items()}
    read = {c: F.try_to_timestamp(given[c]).cast("timestamp") if t == "timestamp" else given[c].try_cast(t) for c, (t, _) in fields.items()}
    unread = F.array_compact(F.array(*[F.when(given[c].isNotNull() & read[c].isNull(), c) for c in fields]))
    judged = raw.withColumn("_unread", unread)
    default = {c: F.lit(d) for c, (_, d) in fields.items() if d is not None}
    if kind == "users":
        default["username"] = F.concat(F.lit("imported_"), F.substring(F.md5(F.to_json(F.struct(*raw.columns))), 1, 12))
    rows = judged.where(F.size("_unread") == 0).select(*[F.coalesce(read[c], default[c]).alias(c) if c in default else read[c].alias(c) for c in fields])
    return rows, judged.where(F.size("_unread") > 0).withColumnRenamed("_unread", "fields")


def file_category(name: Column) -> Column:
    """Category by file name; the first rule that holds wins."""
    low = F.lower(name)
    either = lambda a, b: F.contains(low, F.lit(a)) | F.contains(low, F.lit(b))
    return F.when(either("气功", "qigong"), "气功").when(either("中医", "tcm"), "中医").when(either("儒家", "confucian"), "儒家").otherwise("气功")


def new_titles(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per title that is not there yet."""
    return incoming.dropDuplicates(["title"]).join(existing.select("title"), "title", "left_anti")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_by_category(df: DataFrame, path: str) -> None:
    """JSON files by category, and how many rows each has in `path`_stats."""
    df.write.mode("overwrite").partitionBy("category").json(path)
    df.groupBy("category").agg(F.count("*").alias("rows")).write.mode("overwrite").json(f"{path}_stats")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON, CSV, HTML (one table, in one file) or text (one string column)."""
    if kind not in ("json", "csv", "html", "text"):
        raise ValueError(f"no report of kind {kind}")
    if kind == "html":
        df, kind = html_table(df), "text"
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else getattr(writer, kind)(path)


def html_table(df: DataFrame) -> DataFrame:
    """value: the lines of an HTML table of a report, whose rows are few; nulls are empty cells, and markup in values is shown as it is."""
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))

    def shown(c: Column) -> Column:
        out = F.coalesce(c.cast("string"), F.lit(""))
        for a, b in marks:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    line = lambda tag, cells: F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit(f"<{tag}>"), shown(c), F.lit(f"</{tag}>"))], F.lit("</tr>"))
    ordered = F.array_sort(F.collect_list(line("td", [F.col(f"`{c}`") for c in df.columns])))
    head = F.array(F.lit("<table>"), line("th", [F.lit(c) for c in df.columns]))
    return df.agg(F.explode(F.concat(head, ordered, F.array(F.lit("</table>")))).alias("value"))


def listed_documents(files: DataFrame, category: str, limit: int | None = None) -> DataFrame:
    """title, content, category, tags of a listing (path): the title is the file's name without its extension, the content says where it comes from. limit: the first so many by path."""
    rows = files if limit is None else files.orderBy("path").limit(limit)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("title"), F.concat(F.lit("来源: "), "path").alias("content"), F.lit(category).alias("category"), F.array().cast("array<string>").alias("tags"))


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
