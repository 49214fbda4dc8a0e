"""Candidate pairs from shared buckets, and components of verified links.

All of it is DataFrame work. A bucket is never expanded into all its pairs up front:
first each member meets one leader, the member that shares most buckets; only members
that are still in different components after that meet each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed


def crowded(members: DataFrame) -> DataFrame:
    """Members (``key``, ``node``) of buckets with more than one, and the bucket's size ``n``."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return checkpointed(members.join(sizes, "key"), "crowded")


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of a bucket's leader with each other member.

    The leader meets the most members over all its buckets, so that the middle of a group
    leads wherever it stands; ties go to the smaller node.
    """
    degree = buckets.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = buckets.join(degree, "node")
    leads = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("lead")) \
        .select("key", (-F.col("lead.minus")).alias("leader"))
    pairs = buckets.join(leads, "key").where("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def within_reach(similarity: float, words: int) -> Column:
    """Whether ``size, marks`` and ``size2, marks2`` allow the similarity.

    ``marks`` are the parities of a set's elements in some cells; where two sets differ in
    ``d`` parities, at least ``d`` elements are in one of them only, so that their Jaccard
    similarity is at most ``(sizes - d) / (sizes + d)``. The bound is exact: no link is lost.
    """
    apart = sum((F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("marks2", F.lit(i)))) for i in range(words)), F.lit(0))
    low = similarity - 1e-9  # a similarity met exactly must pass
    return (F.least("size", "size2") >= low * F.greatest("size", "size2")) \
        & (apart * (1 + low) <= (F.col("size") + F.col("size2")) * (1 - low))


def open_pairs(buckets: DataFrame, roots: DataFrame, light: DataFrame, similarity: float, words: int) -> DataFrame:
    """Distinct pairs ``a < b`` that share a bucket but not a component, with ``size`` and ``size2``.

    The join itself leaves out pairs that can't reach the similarity, and makes a pair in
    the first bucket that both are in, however many these are.
    """
    keys = buckets.groupBy("node").agg(F.collect_set("key").alias("keys"))
    placed = buckets.join(roots, "node", "left").join(light, "node").join(keys, "node") \
        .select("key", "node", "size", "marks", "keys", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .where("low < high").select("key")
    left = checkpointed(placed.join(mixed, "key"), "open")
    right = left.withColumnsRenamed({"node": "node2", "root": "root2", "size": "size2", "marks": "marks2", "keys": "keys2"})
    once = F.array_min(F.array_intersect("keys", "keys2")) == F.col("key")
    return left.join(right, "key").where(F.expr("node < node2 and root <> root2") & within_reach(similarity, words) & once) \
        .select(F.col("node").alias("a"), F.col("node2").alias("b"), "size", "size2").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of a link; the root is a node of the component.

    Every node joins its first neighbour, by the magnitude of the degree and then by a
    hash, and the graph shrinks to the roots. A star is gone in one round, whatever its
    size; inside a magnitude the hashed order makes the rounds few.
    """
    edges = checkpointed(links.select("a", "b").where("a <> b"), "edges")
    roots = checkpointed(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                         .select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        magnitude = -F.floor(F.log2(F.count("*"))).cast("int")
        ranks = both.groupBy("a").agg(magnitude.alias("level")) \
            .select("a", F.struct("level", F.xxhash64("a", F.lit(turn)).alias("hash"), F.col("a").alias("node")).alias("rank"))
        beside = both.join(ranks.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("rank").alias("best"))
        near = beside.join(ranks, "a").select("a", F.least("best", "rank").alias("best"))
        up = checkpointed(near.select(F.col("a").alias("node"), F.col("best.node").alias("up")), "up")
        roots = checkpointed(roots.join(up.withColumnRenamed("node", "root"), "root", "left")
                             .select("node", F.coalesce("up", "root").alias("root")), "roots")
        moved = edges.join(up.withColumnsRenamed({"node": "a", "up": "up_a"}), "a") \
            .join(up.withColumnsRenamed({"node": "b", "up": "up_b"}), "b") \
            .where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = checkpointed(moved.distinct(), "edges")
        turn += 1
    return roots


def link_groups(members: DataFrame, describe: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                similar: Callable[[DataFrame], DataFrame], similarity: float, words: int) -> tuple[DataFrame, DataFrame]:
    """Components and verified links of everything that shares a bucket.

    ``members`` holds ``key`` and ``node``. ``describe`` gets the nodes that share any
    bucket and returns two written tables, ``node``, ``set`` and ``node``, ``size``, ``marks``
    (``words`` longs, see ``within_reach``); ``similar`` gets pairs with ``set_a``, ``set_b``
    and their ``size`` and ``size2``, and returns the links ``a``, ``b`` among them. A pair in a bucket goes
    unverified only if its members are already in one component.
    """
    buckets = crowded(members)
    # written, so that its size is known where it meets the texts
    asked = checkpointed(buckets.select("node").distinct(), "asked")
    plain, light = describe(asked)

    def verified(pairs: DataFrame) -> DataFrame:
        return similar(pairs.join(plain.withColumnsRenamed({"node": "a", "set": "set_a"}), "a")
                       .join(plain.withColumnsRenamed({"node": "b", "set": "set_b"}), "b"))

    tried = checkpointed(leader_pairs(buckets), "tried")
    # only pairs that can reach the similarity fetch their sets
    likely = tried.join(light.withColumnsRenamed({"node": "a"}), "a") \
        .join(light.withColumnsRenamed({"node": "b", "size": "size2", "marks": "marks2"}), "b") \
        .where(within_reach(similarity, words)).select("a", "b", "size", "size2")
    links = checkpointed(verified(likely), "links")
    roots = components(links)
    rest = checkpointed(open_pairs(buckets, roots, light, similarity, words).join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = checkpointed(links.unionByName(verified(rest)), "links")
        roots = components(links)
    return roots, links
