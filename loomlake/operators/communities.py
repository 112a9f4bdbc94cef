"""Communities of a graph by label propagation in stored rounds, and their modularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored

ROUNDS = 10


def _counted(edges: DataFrame) -> DataFrame:
    """a, b, w: undirected links of edges (source, target), w how many edges there are in either direction; loops and null ends are left out."""
    ends = edges.where("source is not null and target is not null and source != target")
    return ends.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count("*").alias("w"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def weighted(edges: DataFrame) -> DataFrame:
    """a, b, w: the links of edges (source, target), each in both directions."""
    return _both_ways(_counted(edges))


def communities(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """name, community: vertices of edges (source, target) that hang together more than with others; a community is called by one of its vertices.

    Every vertex begins as its own community. In a round each vertex takes the label with the largest weight of links to it,
    its own label counting as one link more and the least label among equals; in odd rounds the labels may only fall, in
    even ones only rise, so that no two neighbours swap labels for ever. It ends when nothing changes, or after `rounds`.

    Vertices are numbered in the order of their names, so rounds join, compare and sum numbers. A round is a join of links
    with the labels of one end and two sums, both combined before the shuffle: by (vertex, label), then by vertex, where a
    vertex's own label comes along. So a hub's links are summed where they lie, and what meets at it is a row for each label
    among its neighbours and partition. Rounds are stored, so plans do not grow.
    """
    named = stored(_counted(edges), "links")
    names = stored(named.select(F.explode(F.array("a", "b")).alias("name")).distinct().orderBy("name").withColumn("id", F.monotonically_increasing_id()), "names")
    end = lambda c: names.select(F.col("name").alias(c), F.col("id").alias(f"_{c}"))
    links = stored(named.join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"), "links")
    links = _both_ways(links)
    labels = names.select("id", F.col("id").alias("community"))
    quiet = 0
    for n in range(rounds):
        own = labels.select(F.col("id").alias("a"), F.col("community").alias("label"), F.lit(1).cast("long").alias("w"), F.col("community").alias("own"))
        told = links.join(labels.select(F.col("id").alias("b"), F.col("community").alias("label")), "b").select("a", "label", "w", F.lit(None).cast("long").alias("own"))
        weight = told.unionByName(own).groupBy("a", "label").agg(F.sum("w").alias("w"), F.max("own").alias("own"))
        best = F.min_by("label", F.struct((-F.col("w")).alias("w"), "label"))
        least = weight.groupBy("a").agg(F.max("own").alias("community"), best.alias("label"))
        allowed = F.col("label") < F.col("community") if n % 2 == 0 else F.col("label") > F.col("community")
        moved = least.select(F.col("a").alias("id"), F.when(allowed, F.col("label")).otherwise(F.col("community")).alias("community"), allowed.alias("changed"))
        moved = stored(moved, "labels")
        labels = moved.select("id", "community")
        quiet = quiet + 1 if moved.where("changed").isEmpty() else 0
        if quiet == 2:
            break
    called = labels.join(names, "id").select("name", "community")
    labels = called.join(names.select(F.col("id").alias("community"), F.col("name").alias("_called")), "community").select("name", F.col("_called").alias("community"))
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """modularity, communities, vertices (one row): the share of links within communities less what chance would give, of labels (name, community)."""
    links = weighted(edges)
    named = lambda end: labels.select(F.col("name").alias(end), F.col("community").alias(f"_{end}"))
    both = links.join(named("a"), "a").join(named("b"), "b")
    per = both.groupBy(F.col("_a").alias("community")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(F.lit(0))).alias("within"))
    total = per.agg(F.sum("degree").alias("m2"))
    share = F.col("within") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), F.lit(2.0))
    found = per.join(total).agg(F.coalesce(F.sum(share), F.lit(0.0)).alias("modularity"), F.count("*").alias("communities"))
    return found.join(labels.agg(F.count("*").alias("vertices")))


def community_sizes(labels: DataFrame) -> DataFrame:
    """community, vertices, rank of labels (name, community), the largest first."""
    sizes = labels.groupBy("community").agg(F.count("*").alias("vertices"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("vertices"), "community")))
