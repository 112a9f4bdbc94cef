"""Entity graph: extraction, co-occurrence, neighbours, shortest paths. Vertices are entity names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import mentions

# Entity types and the names that belong to them.
ENTITY_PATTERNS = {
    "功法": "(八段锦|五禽戏|太极拳|六字诀|易筋经|形意拳|八卦掌)",
    "穴位": "(百会|膻中|气海|关元|命门|涌泉|足三里|合谷|太冲)",
    "概念": "(气|丹田|经络|气血|阴阳|虚实|寒热|表里)",
    "动作": "(站桩|打坐|吐纳|导引|行气|采气|发气)",
    "脏腑": "(心|肝|脾|肺|肾|胃|胆|膀胱|三焦)",
}


def entities(docs: DataFrame, patterns: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """key, ordinal, name, type: the names in a text, each once, in the order of the patterns and then of the text."""
    return mentions.entities(docs, mentions.listed(patterns or ENTITY_PATTERNS), key)


def cooccurrences(docs: DataFrame, patterns: dict[str, str] | None = None, gap: int = 50, key: str = "doc_id") -> DataFrame:
    """key, source, target: entities of one text within `gap` characters of each other on one line, in either order; the one found first is the source."""
    return mentions.close_pairs(docs, mentions.listed(patterns or ENTITY_PATTERNS), gap, key)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).where("source != target").distinct()


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    return undirected(edges).where(F.col("source") == name).select(F.col("target").alias("name"))


def shortest_paths(edges: DataFrame, start: str, max_depth: int = 3) -> DataFrame:
    """name, hops, path of every vertex within max_depth edges of start; of equally short paths the least by name.

    A frontier join for each hop; the frontier keeps one path per vertex, so it never outgrows the vertices. Links and
    frontiers are stored, so a hop's plan does not contain the earlier ones.
    """
    links = stored(undirected(edges), "links")
    reached = stored(links.where(F.col("source") == start).limit(1).select(F.lit(start).alias("name"), F.lit(0).alias("hops"), F.array(F.lit(start)).alias("path")), "hop-0")
    frontier = reached
    for hop in range(1, max_depth + 1):
        step = frontier.join(links, frontier["name"] == links["source"]).select(F.col("target").alias("name"), F.concat("path", F.array("target")).alias("path"))
        frontier = stored(step.groupBy("name").agg(F.lit(hop).alias("hops"), F.min("path").alias("path")).join(reached.select("name"), "name", "left_anti"), f"hop-{hop}")
        reached = reached.unionByName(frontier)
    return reached


def path_details(edges: DataFrame, path: DataFrame) -> DataFrame:
    """step, from, relation, to: the pairs of a path (an array column `path`, one row) with the relation of the edge in that direction, null where there is none.

    edges: source, target, relation. Of several relations the least counts.
    """
    pairs = path.select(F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(x.alias("source"), F.get("path", i + 1).alias("target")))).alias("step", "p")).select("step", "p.*")
    named = edges.join(F.broadcast(pairs.select("source", "target")), ["source", "target"], "left_semi").groupBy("source", "target").agg(F.min("relation").alias("relation"))
    return pairs.join(named, ["source", "target"], "left").select("step", F.col("source").alias("from"), "relation", F.col("target").alias("to"))


def hop_steps(edges: DataFrame, start: str, end: str, related: int = 5, max_depth: int = 3) -> DataFrame:
    """ordinal, text: the path between two entities, the relations along it, and up to `related` names around both, as lines of reasoning."""
    path = stored(shortest_paths(edges, start, max_depth).where(F.col("name") == end).select("path"), "path")
    whole = path.select(F.lit(0).alias("ordinal"), F.concat(F.lit("发现实体间路径: "), F.array_join("path", " → ")).alias("text"))
    relations = path_details(edges, path).where("relation is not null").select((F.col("step") + 1).alias("ordinal"), F.format_string("关系: %s --[%s]--> %s", "from", "relation", "to").alias("text"))
    around = undirected(edges).where(F.col("source").isin(start, end) & ~F.col("target").isin(start, end)).select("target").distinct().orderBy("target").limit(related)
    names = around.agg(F.array_sort(F.collect_list("target")).alias("n")).where(F.size("n") > 0)
    return whole.unionByName(relations).unionByName(names.select(F.lit(max_depth + 1).alias("ordinal"), F.concat(F.lit("相关实体: "), F.array_join("n", ", ")).alias("text")))


def closure(edges: DataFrame) -> DataFrame:
    """source, target: every pair of which the second is reached from the first, along one edge or more; edges (source, target) may form cycles.

    Paths double in each round, so rounds are the logarithm of the longest; each is stored. Null ends are left out.
    """
    known = stored(edges.where("source is not null and target is not null").select("source", "target").distinct(), "closure")
    size, more = 0, known.count()
    while more > size:
        size = more
        joined = known.alias("a").join(known.alias("b"), F.col("a.target") == F.col("b.source")).select(F.col("a.source").alias("source"), F.col("b.target").alias("target"))
        known = stored(known.unionByName(joined).distinct(), "closure")
        more = known.count()
    return known


def inherited(permissions: DataFrame, parents: DataFrame) -> DataFrame:
    """role, permission of each role: its own (role, permission), and those of all roles it reaches by parents (role, parent)."""
    reached = closure(parents.select(F.col("role").alias("source"), F.col("parent").alias("target")))
    below = reached.join(permissions.withColumnRenamed("role", "target"), "target").select(F.col("source").alias("role"), "permission")
    return permissions.select("role", "permission").unionByName(below).distinct()


def graph_counts(edges: DataFrame) -> DataFrame:
    """entities, relations: what an export of the graph holds."""
    ends = edges.select(F.col("source").alias("v")).unionByName(edges.select(F.col("target").alias("v")))
    return ends.distinct().agg(F.count("*").alias("entities")).join(edges.agg(F.count("*").alias("relations")))


def subgraph(edges: DataFrame, seeds: list[str]) -> DataFrame:
    """The edges between the seeds and their direct neighbours."""
    asked = edges.sparkSession.createDataFrame([("", s) for s in dict.fromkeys(seeds)], "question string, name string")
    return subgraphs(edges, asked, "question").select("source", "target")


def subgraphs(edges: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """key, source, target: for each question, the edges between the names it asks for (key, name) and their direct neighbours.

    Both ends of an edge are looked up by (question, name), so a question's rows are dealt by name, and so are the edges.
    """
    links = undirected(edges).select(F.col("source").alias("name"), F.col("target").alias("v"))
    near = asked.select(key, "name").join(links, "name").select(key, F.explode(F.array("name", "v")).alias("v")).distinct()
    once = edges.select("source", "target").distinct()
    begun = once.join(near.withColumnRenamed("v", "source"), "source")
    return begun.join(near.withColumnRenamed("v", "target"), [key, "target"], "left_semi").select(key, "source", "target")
