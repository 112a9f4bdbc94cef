"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing and sharding, one stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm.common import Scratch, aside, keyed, table
from loomlake.llm.decontam import decontaminate
from loomlake.llm.minhash import near_duplicates
from loomlake.llm.mixing import mixed_documents
from loomlake.llm.sharding import shard_documents
from loomlake.llm.toxicity import fit_toxicity, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection bound. The model is fitted on the labelled documents of the input."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    named, back = aside(docs, "severity", "toxic")
    return toxicity(named, model).where("not toxic").select(*back)


def _kept(docs: DataFrame, name: str, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs whose number is among the doc_ids that judge(doc_id, text) returns; rows are numbered in the order of doc_id, so that null and repeated ids are rows of their own."""
    named, back = aside(docs, "rid")
    rows, _ = keyed(named, Scratch(docs.sparkSession, name), *[c for c in named.columns if c not in ("doc_id", "text")])
    kept = judge(rows.select(F.col("rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"))
    return rows.join(kept, "rid", "left_semi").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return _kept(docs, "unique", lambda rows: near_duplicates(rows, words=5, percent=80).where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _kept(docs, "clean", lambda rows: decontaminate(rows, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as the mix of sources takes them; a document that is drawn twice is there twice."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, shard, slot and size of every document."""
    return shard_documents(docs.select("doc_id", "text")).select("doc_id", "size", "law", "shard", "slot")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("sharding", shard)]

#: None of the stages can be put in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written and read again before the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
