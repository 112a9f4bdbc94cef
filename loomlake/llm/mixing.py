"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents form one stream of words, cut into blocks. The quota of a source is a number of block draws. A
binary tree over the output shards splits the quota vector: each node deals its left half a multivariate-hypergeometric
part of what it holds, so that shards differ by chance and the totals are exact. Shards then own disjoint ranges of each
source's draws; a keyed permutation of the block numbers, anew for each pass, says which block a draw is. A document's
words are taken by the shards' draws and by nothing else. Within a shard, draws are shuffled by a random key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, aside, keyed, let, table, with_ids, without, words

CYCLE = (5, 2, 1)  # weights by the rank of the source
MOST = 3  # a target is at most so many times its source's size
BLOCK_WORDS = 128
SHARDS = 16
CHUNKS = 1024  # parts of each source for the running sums
SEED = 20240607
ROUNDS = 16  # of the permutation


def target_weights(sizes: DataFrame, cycle=CYCLE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size; a row per source) with rank, weight and target.

    Weights repeat in the order of the sources (code points, null last). Targets share the sum of sizes by weight; none is
    above `most` times its size, and the excess is reshared by weight: target = min(most * size, level * weight), where the
    level is the largest of the levels found when sources are closed in the order of most * size / weight.
    """
    everything = Window.partitionBy()
    by_source = Window.orderBy(F.asc_nulls_last("source"))
    closed = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return (
        sizes.withColumn("rank", F.row_number().over(by_source))
        .withColumn("weight", F.element_at(weights, (F.pmod(F.col("rank") - 1, F.lit(len(cycle))) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(closed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(closed.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.max((F.col("_all") - F.col("_before")) / F.col("_rest")).over(everything))
        .withColumn("target", F.least("_cap", F.col("_level") * F.col("weight")))
        .drop("_cap", "_all", "_before", "_rest", "_level")
    )


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) by hash."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` are good, when `good` of `total` are, at the uniform number u: the inverse of the law, from its mode outwards.

    Weights relative to the mode's follow by the law's ratios, out to nine deviations, where what is left is below the
    resolution of u. A first walk adds them up, a second one stops where u times the sum is used up.
    """

    def walk(p: Column) -> Column:
        n, k, m, mode = p["n"], p["k"], p["m"], p["mode"]
        times = lambda a, b: a.cast("double") * b.cast("double")  # noqa: E731  products of numbers of blocks outgrow 64 bits
        up = lambda x: times(k - x, m - x) / times(x + 1, n - k - m + x + 1)
        down = lambda x: times(x, n - k - m + x) / times(k - x + 1, m - x + 1)
        reach = F.sequence(F.lit(1).cast("long"), p["reach"])
        one, zero = F.lit(1.0), F.lit(0.0)
        step = lambda acc, j: (acc["a"] * up(mode + j - 1), F.when(acc["b"] > 0, acc["b"] * down(mode - j + 1)).otherwise(zero))

        def add(acc, j):
            a, b = step(acc, j)
            return let(F.struct(a.alias("a"), b.alias("b")), lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), (acc["s"] + w["a"] + w["b"]).alias("s")))

        def stop(acc, j):
            a, b = step(acc, j)

            def use(w):
                left = acc["left"] - w["a"]
                at = F.when(left < 0, mode + j).when(left < w["b"], mode - j)
                return F.struct(w["a"].alias("a"), w["b"].alias("b"), (left - w["b"]).alias("left"), at.alias("at"))

            return F.when(acc["at"].isNotNull(), acc).otherwise(let(F.struct(a.alias("a"), b.alias("b")), use))

        whole = F.aggregate(reach, F.struct(one.alias("a"), one.alias("b"), one.alias("s")), add)["s"]
        left = whole * p["u"] - 1
        begin = F.struct(one.alias("a"), one.alias("b"), left.alias("left"), F.when(left < 0, mode).alias("at"))
        return F.coalesce(F.aggregate(reach, begin, stop)["at"], mode)

    def with_mode(p: Column) -> Column:
        n, k, m = p["n"], p["k"], p["m"]
        least, most = F.greatest(F.lit(0).cast("long"), m - (n - k)), F.least(k, m)
        mode = F.greatest(least, F.least(most, F.floor((m + 1) * (k + 1).cast("double") / (n + 2)).cast("long")))
        share = k / F.greatest(n, F.lit(1))
        deviation = F.sqrt(m * share * (1 - share) * (n - m) / F.greatest(n - 1, F.lit(1)))
        reach = F.least(F.ceil(9 * deviation + 30), F.greatest(mode - least, most - mode) + 1)
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), p["u"].alias("u"), mode.alias("mode"), reach.alias("reach"))

    long = lambda c, name: c.cast("long").alias(name)
    given = F.struct(long(total, "n"), long(good, "k"), long(draws, "m"), u.alias("u"))
    return let(given, lambda p: let(with_mode(p), walk))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """rank, bounds (an array of shard, first, n by shard): the range of each source's draws that each shard owns.

    quotas: rank, quota (draws), a row per source. At a node the left half's share of one source after another is drawn
    from the hypergeometric law given what is left, so that every node's counts add up exactly. One row holds a node; rows
    and arrays have the size of sources x shards, never of the documents.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.transform("q", lambda x: x["quota"]).alias("q"))
    add = lambda a, x: a + x
    levels = shards
    while levels > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), add)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        deal = F.struct(total.alias("left"), F.floor(total * (middle - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("room"), F.array().cast("array<bigint>").alias("taken"))

        def step(acc, q):
            u = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), F.size(acc["taken"]))
            return let(hypergeometric(acc["left"], q, acc["room"], u), lambda x: F.struct((acc["left"] - q).alias("left"), (acc["room"] - x).alias("room"), F.concat(acc["taken"], F.array(x)).alias("taken")))

        split = node.withColumn("mid", middle).withColumn("a", F.when(F.col("hi") - F.col("lo") > 1, F.aggregate("q", deal, step)["taken"]))
        node = split.select(
            F.inline(
                F.when(F.col("a").isNull(), F.array(F.struct("lo", "hi", "q"))).otherwise(
                    F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("a").alias("q")), F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("q", "a", lambda x, y: x - y).alias("q")))
                )
            )
        )
        levels = (levels + 1) // 2
    dealt = node.select("lo", F.posexplode("q").alias("i", "n")).withColumn("first", F.sum("n").over(Window.partitionBy("i").orderBy("lo")) - F.col("n"))
    return dealt.groupBy((F.col("i") + 1).alias("rank")).agg(F.array_sort(F.collect_list(F.struct(F.col("lo").alias("shard"), "first", "n"))).alias("bounds"))


def permuted(x: Column, key: Column, of: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the numbers 0 to of - 1: each round pairs x with a random number less x, and a bit of the pair's hash says whether the two change places."""

    def turn(x: Column, r: Column) -> Column:
        return let(F.pmod(F.pmod(F.xxhash64(key, r), of) - x, of), lambda y: F.when(F.xxhash64(key, r, F.greatest(x, y)).bitwiseAND(F.lit(1).cast("long")) == 1, y).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, turn)


def _drawn(rows: DataFrame, cycle, most: float, block_words: int, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """rid, source, size, source_size, target, draws and taken of rows (rid, text, source)."""
    thin = scratch.save(
        rows.select(
            "rid",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"),  # an equi-join needs a key that is never null
            F.xxhash64(F.lit(seed), "rid").alias("_at"),
        ).withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), "_at"), F.lit(CHUNKS)).cast("int")),
        "sizes",
    )
    chunks = thin.groupBy("_key", "_chunk").agg(F.sum("size").alias("_in_chunk"), F.first("source").alias("_source"))
    sizes = chunks.groupBy("_key").agg(F.sum("_in_chunk").alias("source_size"), F.first("_source").alias("source"))
    size, b = F.col("source_size"), F.lit(block_words).cast("long")
    plan = (
        target_weights(sizes, cycle, most)
        .withColumn("_words", F.round("target").cast("long"))
        .withColumn("_passes", F.when(size > 0, F.floor(F.col("_words") / size)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_more", F.col("_words") - F.col("_passes") * size)
        .withColumn("_blocks", F.ceil(size / b))
        .withColumn("_full", F.floor(size / b))
        .withColumn("quota", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_more") / b))
        .withColumn("_seed", F.xxhash64(F.lit(seed), "_key"))
    )
    plan = scratch.save(plan, "plan")
    off = F.array_max(F.transform("bounds", lambda x: F.abs(x["shard"] - F.floor(x["first"] * shards / F.greatest(F.col("quota"), F.lit(1))))))
    plan = plan.join(splitting_tree(plan.select("rank", "quota"), shards, seed), "rank").withColumn("_off", (off + 1).cast("int")).drop("rank", "weight", "source")
    plan = scratch.save(plan, "bounds")
    placed = chunks.withColumn("_base", F.sum("_in_chunk").over(Window.partitionBy("_key").orderBy("_chunk")) - F.col("_in_chunk")).select("_key", "_chunk", "_base").join(plan, "_key")
    order = Window.partitionBy("_key", "_chunk").orderBy("_at", "rid")
    at = (
        thin.select("rid", "source", "size", "_key", "_chunk", "_at")
        .withColumn("_within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(placed, ["_key", "_chunk"])
        .withColumn("_from", F.col("_base") + F.col("_within"))
        .withColumn("_to", F.col("_from") + F.col("size"))
    )
    full, blocks = F.col("_full"), F.col("_blocks")

    def owner(draw: Column) -> Column:
        """The shard whose range holds the draw; it is at most _off shards from where shards of equal ranges would have it."""
        near = F.floor(draw * shards / F.greatest(F.col("quota"), F.lit(1))).cast("int")
        some = F.slice("bounds", F.greatest(near - F.col("_off") + 1, F.lit(1)), 2 * F.col("_off") + 2)
        return F.get(F.filter(some, lambda x: (x["first"] <= draw) & (draw < x["first"] + x["n"])), F.lit(0))["shard"]

    def piece(block: Column, passed: Column) -> Column:
        last = passed == F.col("_passes")
        key = F.xxhash64("_seed", passed)
        nth = F.when(~last, permuted(block, key, blocks)).when(block < full, permuted(block, key, full)).otherwise(full)

        def of(nth: Column) -> Column:
            length = F.when(last, F.greatest(F.lit(0).cast("long"), F.least(b, F.col("_more") - nth * b))).otherwise(b)
            first, end = F.greatest("_from", block * b), F.least(F.col("_to"), block * b + length, F.col("source_size"))
            draw = passed * blocks + nth
            return F.struct(F.when(end > first, owner(draw)).alias("shard"), F.xxhash64("_seed", draw, first).alias("key"), passed.alias("pass"), (first - F.col("_from")).alias("first_word"), (end - first).alias("n_words"))

        return let(nth, of)

    in_blocks = F.sequence(F.floor(F.col("_from") / b), F.floor((F.col("_to") - 1) / b))
    zero = F.lit(0).cast("long")
    pieces = F.flatten(F.transform(in_blocks, lambda k: F.transform(F.sequence(zero, F.col("_passes")), lambda p: piece(k, p))))
    drawn = F.filter(F.when(F.col("size") > 0, pieces), lambda x: x["shard"].isNotNull())
    return (
        at.withColumn("draws", F.coalesce(drawn, F.array().cast("array<struct<shard:int,key:bigint,pass:bigint,first_word:bigint,n_words:bigint>>")))
        .withColumn("taken", F.aggregate("draws", zero, lambda a, x: a + x["n_words"]))
        .select("rid", "source", "size", "source_size", "target", "draws", "taken")
    )


def mix_sources(docs: DataFrame, cycle=CYCLE, most: float = MOST, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, draws and taken of every row of docs (doc_id, text, source; more columns are ignored).

    draws: array of (shard, key, pass, first_word, n_words), the pieces of the document that the shards draw; within a
    shard pieces are shuffled by ascending key. taken: the words in all of them. A source's taken words are its target,
    rounded. Size is the number of words; null and blank texts have none and are never drawn. Null is a source of its own.
    Rows that repeat a doc_id are documents of their own, ordered by text and source. An empty table gives an empty result.
    Sources are few: their plan, of sources x shards numbers, is one row.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, same = keyed(docs, scratch, "source")
    return with_ids(_drawn(rows, cycle, most, block_words, shards, seed, scratch), rows, same)


def _mixed(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """docs with rid, and rid, size, draws of the mix."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, _ = keyed(docs, scratch, *[c for c in docs.columns if c not in ("doc_id", "text")])
    given = {"cycle": CYCLE, "most": MOST, "block_words": BLOCK_WORDS, "shards": SHARDS, "seed": SEED} | options
    return rows, _drawn(rows, **given, scratch=scratch).select("rid", "size", "draws")


def mixed_pieces(docs: DataFrame, **options) -> DataFrame:
    """shard, key, pass and docs' columns, where text is the piece's words joined by one space: a row for each draw; ascending key is the shard's order.

    Columns of docs named rid, shard, key or pass give way.
    """
    rows, drawn = _mixed(without(docs, "rid", "shard", "key", "pass"), **options)
    part = F.array_join(F.slice(words(F.col("text")), (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    pieces = drawn.select("rid", F.inline("draws")).join(rows, "rid")
    return pieces.withColumn("text", part).select("shard", "key", "pass", *[f"`{c}`" for c in rows.columns if c != "rid"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Whole documents as the mix takes them, with all columns of docs: a row for each draw of a document's first word.

    Documents without words are kept once. Partitions are ordered by the draws' shard and key.
    """
    docs, back = aside(docs, "rid", "shard", "key", "size", "draws")
    rows, drawn = _mixed(docs, **options)
    starts = F.filter("draws", lambda x: x["first_word"] == 0)
    none = F.array(F.struct(F.lit(0).alias("shard"), F.xxhash64("rid").alias("key")))
    times = F.when(F.col("size") == 0, none).otherwise(F.transform(starts, lambda x: F.struct(x["shard"].alias("shard"), x["key"].alias("key"))))
    return drawn.select("rid", F.inline(times)).join(rows, "rid").sortWithinPartitions("shard", "key").select(*back)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.transform("draws", lambda x: x["shard"]).alias("shards"), F.transform("draws", lambda x: x["key"]).alias("keys"))
