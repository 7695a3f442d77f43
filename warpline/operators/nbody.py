"""N-body steps over a table of points and a table of (target, actor) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.functions.vectors import f32
from warpline.plans.scratch import Scratch


def accelerations(points: DataFrame, pairs: DataFrame, attract: bool = False) -> DataFrame:
    """``(id, ax, ay, az)``: for each target the sum over its actors, terms in 32 bits, sums in 64.

    ``points(id, x, y, z, mass)`` floats. The vector runs from actor to target
    (repulsion); ``attract`` turns it round. A pair of a point with itself, or
    of two points at one place, adds nothing. Points are merged with the pairs
    and never broadcast: Spark's estimate is their file, far less than the
    driver's memory would hold.
    """
    t = points.select(F.col("id").alias("target"), *[F.col(c).alias(f"t{c}") for c in "xyz"]).hint("merge")
    a = points.select(F.col("id").alias("actor"), "mass", *[F.col(c).alias(f"a{c}") for c in "xyz"]).hint("merge")
    sign = f32(-1.0 if attract else 1.0)
    d = pairs.join(t, "target").join(a, "actor").select("target", "mass", *[(F.col(f"t{c}") - F.col(f"a{c}")).alias(c) for c in "xyz"])
    d = d.withColumn("d2", F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")).where("d2 > 0")
    s = F.col("mass") * (f32(1.0) / f32(F.sqrt(F.col("d2") * F.col("d2") * F.col("d2"))))
    d = d.withColumn("s", f32(s) * sign)
    return d.groupBy(F.col("target").alias("id")).agg(*[F.sum(f32(F.col(c) * F.col("s")).cast("double")).alias(f"a{c}") for c in "xyz"])


def step(state: DataFrame, pairs: DataFrame, attract: bool = False) -> DataFrame:
    """``state(id, x, y, z, mass, vx, vy, vz)`` after one step; points without actors keep their velocity."""
    acc = accelerations(state.select("id", "x", "y", "z", "mass"), pairs, attract).hint("merge")
    moved = state.join(acc, "id", "left").withColumns({f"v{c}": f32(F.col(f"v{c}") + F.coalesce(F.col(f"a{c}"), F.lit(0.0))) for c in "xyz"})
    return moved.select("id", *[f32(F.col(c) + F.col(f"v{c}")).alias(c) for c in "xyz"], "mass", "vx", "vy", "vz")


def simulate(points: DataFrame, pairs: DataFrame, steps: int, attract: bool = False) -> DataFrame:
    scratch = Scratch(points.sparkSession, "nbody")
    state = points.select("id", *[f32(F.col(c)).alias(c) for c in ("x", "y", "z", "mass")], *[f32(0.0).alias(f"v{c}") for c in "xyz"])
    for _ in range(steps):
        state = scratch.save(step(state, pairs, attract), "state")
    return state
