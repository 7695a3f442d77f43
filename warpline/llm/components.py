"""Union-find over the edge tables of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.union_find import _spread, components
from warpline.plans.scratch import Scratch, bounded

__all__ = ["_spread", "components", "extended"]


def extended(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``components``' table ``roots(node, root)`` after further ``links(a, b)``; only the roots that these name take part."""
    links = scratch.save(links, "links")
    if links.isEmpty():
        return roots
    held = bounded(roots)
    side = lambda x: held.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    ends = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    new = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch)
    up = bounded(new).select(F.col("node").alias("root"), F.col("root").alias("up"))
    old = roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    first = new.join(held.select("node"), "node", "left_anti").select("node", "root")
    return scratch.save(old.unionByName(first), "labels")
