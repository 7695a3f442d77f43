"""Distributed union-find over an edge table.

Each round every node takes the neighbour (or itself) of least priority, where
priorities are a hash that changes with the round, and the edges are rewritten
between those representatives. A chain of ids therefore halves in expectation
instead of moving by one. Rounds end when no edge is left; the recorded steps
are then composed backwards. No edge, node or label goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.plans.scratch import Scratch, bounded


def _spread(c: Column, r: int) -> Column:
    """Priority in round ``r``, a string so that all rounds share their generated code (numbers are written into it)."""
    return F.xxhash64(c, F.lit(str(r)))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, root)`` for every node with an edge.

    Self-loops and repeated or reversed edges are allowed; rows with a null end
    are ignored. ``root`` is one node of the component, the same for all of it.
    The result is a written table. An empty edge table gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = scratch.save(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    for r in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # least priority among the neighbours and the node itself; equal priorities fall back on the id
        best = both.groupBy("u").agg(F.min_by("v", _spread(F.col("v"), r)).alias("v"))
        step = best.select(
            F.col("u").alias("node"),
            F.when(_spread(F.col("u"), r) <= _spread(F.col("v"), r), F.col("u")).otherwise(F.col("v")).alias("to"),
        )
        step = scratch.save(step, f"step{r}")
        steps.append(step)
        held = bounded(step)
        left = held.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = held.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = e.join(left, "a").join(right, "b").where("ta <> tb")
        nxt = scratch.save(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), f"edges{r}")
        scratch.drop(e)
        e = nxt
    else:
        raise RuntimeError("union-find did not end")
    if not steps:
        return scratch.save(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "labels")
    scratch.drop(e)
    out = bounded(steps[-1]).select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        up = out.select(F.col("node").alias("to"), F.col("root").alias("up"))
        out = step.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("root"))
    out = scratch.save(out, "labels")
    scratch.drop(*steps)
    return out
