"""Rules for paths by prefix, held in a table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_prefixes(rows: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """rows with first and longest: the numbers of the rules (rule, ordinal, prefix) that hold for a path; null where none does.

    `longest` has the longest prefix of the path, `first` the least ordinal, but an exact match comes before any prefix; of
    equal prefixes the one with the least ordinal counts. A path is taken apart into its prefixes of the lengths that rules
    have, of which there are no more than the longest rule has characters, and these are joined with the rules by equality:
    the work grows with paths x lengths, never with paths x rules. Equal paths are looked up once. Null paths match nothing.
    """
    once = rules.where("prefix is not null").groupBy("prefix").agg(F.min(F.struct("ordinal", "rule")).alias("r")).select("prefix", "r.*")
    lengths = once.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("lengths"))
    paths = rows.select(F.col(path).alias("_path")).where("_path is not null").distinct().join(lengths)
    begun = paths.select("_path", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("prefix"))
    by_rank = F.struct((F.col("prefix") != F.col("_path")).alias("inexact"), F.col("ordinal").alias("o"), F.col("rule").alias("r"))
    by_length = F.struct(F.length("prefix").alias("n"), F.col("rule").alias("r"))
    found = begun.join(once, "prefix").groupBy("_path").agg(F.min(by_rank)["r"].alias("first"), F.max(by_length)["r"].alias("longest"))
    return rows.join(found, rows[path] == found["_path"], "left").drop("_path")
