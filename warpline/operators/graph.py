"""Link ranking and connected components over edge tables; node state is a table too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.union_find import components
from warpline.plans.scratch import Scratch, bounded


def pagerank_step(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One step without damping: ``edges(dst, src)``, ``nodes(id, rank, links)`` -> ``nodes``.

    A node's rank becomes the sum of rank / links over its in-links; a node
    without in-links keeps its rank. Zero links give nothing. Edges whose source
    is no node are left out. Sums combine before the shuffle, and a source of
    very many edges is split by the adaptive join.
    """
    given = nodes.select(F.col("id").alias("src"), F.try_divide(F.col("rank"), F.col("links")).alias("_w"))
    new = edges.join(given, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("_w").alias("_new"))
    return nodes.join(new, "id", "left").select("id", F.coalesce("_new", "rank").alias("rank"), "links")


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int) -> DataFrame:
    """``pagerank_step`` repeated; the state is written after each step, so plans don't grow."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    for _ in range(iterations):
        nodes = scratch.save(pagerank_step(edges, nodes), "ranks")
    return nodes


def with_out_links(edges: DataFrame, rank: float = 1.0) -> DataFrame:
    """``nodes`` of an edge table: every end once, with the number of its out-edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(out, "id", "left").select("id", F.lit(rank).alias("rank"), F.coalesce("links", F.lit(0)).alias("links"))


def connected_components(edges: DataFrame, max_iterations: int = 100) -> DataFrame:
    """``(id, label)``: the smallest id of each node's component, over ``edges(a, b)``.

    Union-find, the edges of which shrink by a share in every round, so that all
    rounds together move little more than the first. A node whose only edge is a
    loop is its own component; edges with a null end are left out.
    """
    scratch = Scratch(edges.sparkSession, "components")
    edges = scratch.save(edges.select("a", "b").where("a is not null and b is not null"), "links")
    roots = components(edges, scratch, max_iterations)
    least = scratch.save(roots.groupBy("root").agg(F.min("node").alias("label")), "least")
    labels = roots.join(bounded(least), "root").select(F.col("node").alias("id"), "label")
    loops = scratch.save(edges.where("a = b").select(F.col("a").alias("id")).distinct(), "loops")
    if not loops.isEmpty():
        alone = loops.join(roots.select(F.col("node").alias("id")), "id", "left_anti")
        labels = labels.unionByName(alone.withColumn("label", F.col("id")))
    labels = scratch.save(labels, "labels")
    scratch.drop(edges, roots, least, loops)
    return labels
