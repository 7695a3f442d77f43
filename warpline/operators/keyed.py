"""Keyed reductions and the row operations that DataFrames lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.plans.scratch import Scratch


def vector_sum_by_key(df: DataFrame, keys: list[str], vec: str, count: str | None = None) -> DataFrame:
    """Element-wise sums of a vector column for each key, reassembled in order.

    Elements are summed for each (key, position) with map-side combining, so a
    hot key costs one row for each task and position. ``count`` names a further
    column with the rows of the key. No key gives one row for all.
    """
    flat = df.select(*keys, F.posexplode(vec).alias("_pos", "_x"))
    sums = flat.groupBy(*keys, "_pos").agg(F.sum("_x").alias("_s"), F.count(F.lit(1)).alias("_n"))
    # as many rows for a key as the vector is long
    parts = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "_s"))).alias("_p"), F.max("_n").alias("_n"))
    out = parts.select(*keys, F.transform("_p", lambda p: p["_s"]).alias(vec), *([F.col("_n").alias(count)] if count else []))
    return out


def count_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def zip_with_index(df: DataFrame, order: list[str | Column], index: str = "idx") -> DataFrame:
    """A dense 0-based index in the given order, without gathering rows in one task.

    Rows are range-sorted and written once with their partition-wise number; the
    partitions' sizes (one row each) then give offsets. Ties take any order.
    """
    scratch = Scratch(df.sparkSession, "index")
    numbered = scratch.save(df.sort(*order).withColumn("_mid", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_mid", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    joined = numbered.withColumn("_part", part).join(offsets, "_part")
    return joined.withColumn(index, F.col("_first") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_first", "_mid")


def zip_rows(left: DataFrame, by_left: list[str | Column], right: DataFrame, by_right: list[str | Column]) -> DataFrame:
    """The rows of two tables side by side, place by place in their own orders; both have the same number of rows and no common column."""
    one, two = zip_with_index(left, by_left, "_place"), zip_with_index(right, by_right, "_place")
    return one.join(two, "_place").drop("_place")


def take_sample(df: DataFrame, n: int, seed: int, key: list[str], replacement: bool = False) -> DataFrame:
    """``n`` rows in an order fixed by a hash of ``key`` and ``seed``: the same rows on every run.

    With replacement, ``n`` draws are made against the dense index of the rows.
    """
    if not replacement:
        return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
    rows = zip_with_index(df, list(key), "_i")
    total = F.lit(df.count())
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(total, F.lit(1))).alias("_i"))
    return draws.join(rows, "_i").drop("_i")


def replicate(df: DataFrame, n: int, copy: str = "copy") -> DataFrame:
    """Every row ``n`` times, numbered from 0."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(copy, F.lit(0)).limit(0)


def even_copies(df: DataFrame, n: int, id_: str) -> DataFrame:
    """``n`` copies with ids of their own: id + copy * rows."""
    count = df.count()
    return replicate(df, n, "_copy").withColumn(id_, F.col(id_) + F.col("_copy") * F.lit(count)).drop("_copy")
