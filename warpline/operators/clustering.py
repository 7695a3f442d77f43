"""K-means, fuzzy c-means and genetic clustering over a vector column.

Centres are model parameters: K vectors, whatever the data. They travel to the
tasks as constants; points never leave the executors. Each batch of points is
one matrix product and a handful of partial sums, so the shuffle carries K rows
for each batch and not one for each point.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.functions.vectors import literal_rows, nearest
from warpline.operators.keyed import vector_sum_by_key


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a 2-D array, without copying where it can."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if not len(column):
        return np.zeros((0, 0))
    if len(flat) % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def initial_centres(df: DataFrame, k: int, id_: str, vec: str) -> list[list[float]]:
    """The vectors of the ``k`` lowest ids."""
    return [[float(x) for x in r[vec]] for r in df.orderBy(id_).limit(k).select(vec).collect()]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows of x by rows of c) by differences, in blocks, so that equal vectors are at 0."""
    out = np.empty((len(x), len(c)))
    for j, row in enumerate(c):
        d = x - row
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assign(df: DataFrame, centres: list[list[float]], vec: str) -> DataFrame:
    """Adds ``cid``, the nearest centre's number (ties: the lowest), and ``d2``, its squared distance."""
    return df.withColumn("_n", nearest(F.col(vec).cast("array<double>"), literal_rows(centres))).withColumns({"cid": F.col("_n.id"), "d2": F.col("_n.d2")}).drop("_n")


def _partials(df: DataFrame, vec: str, f) -> DataFrame:
    """Sums by (cid, pos) of what ``f(x)`` gives for each batch: rows (cid, weight, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                cid, n, weight, sums = f(x)
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int32()), pa.array(list(np.c_[n, weight, sums]), pa.list_(pa.float64()))], names=["cid", "v"])

    part = df.select(F.col(vec).cast("array<double>").alias(vec)).where(F.col(vec).isNotNull()).mapInArrow(run, "cid int, v array<double>")
    # the count goes with the vector, so that one aggregation does: doubles hold it exactly below 2**53
    sums = vector_sum_by_key(part, ["cid"], "v")
    return sums.select("cid", F.slice("v", 2, F.size("v") - 1).alias("v"), F.get("v", 0).cast("long").alias("n"))


def kmeans_step(df: DataFrame, centres: list[list[float]], vec: str, engine: str = "arrow") -> DataFrame:
    """``(cid, n, v)``: members and mean of each centre that has members, in one pass."""
    if engine == "native":
        tagged = assign(df, centres, vec)
        sums = vector_sum_by_key(tagged.select("cid", F.col(vec).cast("array<double>").alias("v")), ["cid"], "v", count="n")
        return sums.select("cid", "n", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    c = np.array(centres)

    def f(x: np.ndarray):
        own = _distances(x, c).argmin(axis=1)
        ids = np.unique(own)
        sums = np.array([x[own == i].sum(axis=0) for i in ids])
        n = np.array([(own == i).sum() for i in ids])
        return ids, n, n.astype(float), sums

    out = _partials(df, vec, f)
    return out.select("cid", "n", F.transform(F.slice("v", 2, F.size("v") - 1), lambda x: x / F.get("v", 0)).alias("v"))


def kmeans(df: DataFrame, k: int, iterations: int, vec: str, id_: str, centres: list[list[float]] | None = None, mode: str = "lloyd", engine: str = "arrow") -> list[list[float]]:
    """Centres after some iterations of Lloyd's algorithm; a centre without members stays.

    ``mode="copies"`` averages copies of the nearest centre in place of the
    points, so that centres never move while counts agree with the first step.
    """
    if mode not in ("lloyd", "copies"):
        raise ValueError("mode is lloyd or copies")
    now = initial_centres(df, k, id_, vec) if centres is None else [list(c) for c in centres]
    for _ in range(iterations if mode == "lloyd" else 0):
        for r in kmeans_step(df, now, vec, engine).collect():
            now[r["cid"]] = list(r["v"])
    return now


def memberships(d: np.ndarray, m: float = 2.0) -> np.ndarray:
    """``u^m`` from distances (points by centres): u = 1 / (sum_i d_t / d_i)^(2 / (m - 1)).

    Centres at distance 0 are left out of the sum; an empty or zero sum gives 1.
    """
    with np.errstate(divide="ignore"):
        inv = np.where(d > 0, 1 / d, 0.0).sum(axis=1, keepdims=True)
    total = d * inv
    with np.errstate(divide="ignore"):
        return np.where(total == 0, 1.0, total ** (-2.0 / (m - 1) * m))


def fuzzy_step(df: DataFrame, centres: list[list[float]], vec: str, weighted: bool = True) -> DataFrame:
    """``(cid, n, v)``: new centres. ``weighted=False`` divides the plain sum of the points by the weights' sum."""
    c = np.array(centres)

    def f(x: np.ndarray):
        u = memberships(np.sqrt(_distances(x, c)))
        sums = u.T @ x if weighted else np.tile(x.sum(axis=0), (len(c), 1))
        return np.arange(len(c)), np.full(len(c), len(x)), u.sum(axis=0), sums

    out = _partials(df, vec, f)
    return out.select("cid", "n", F.transform(F.slice("v", 2, F.size("v") - 1), lambda x: x / F.get("v", 0)).alias("v"))


def fuzzy_cmeans(df: DataFrame, k: int, iterations: int, vec: str, id_: str, weighted: bool = True) -> list[list[float]]:
    now = initial_centres(df, k, id_, vec)
    for _ in range(iterations):
        for r in fuzzy_step(df, now, vec, weighted).collect():
            now[r["cid"]] = list(r["v"])
    return now


def fitness(df: DataFrame, population: list[list[list[float]]], vec: str) -> DataFrame:
    """``(cid, n, fitness)``: for each candidate set of centres, the sum over points of the least distance."""
    sets = [np.array(p) for p in population]

    def f(x: np.ndarray):
        least = [np.sqrt(_distances(x, s).min(axis=1)).sum() for s in sets]
        return np.arange(len(sets)), np.full(len(sets), len(x)), np.array(least), np.zeros((len(sets), 0))

    return _partials(df, vec, f).select("cid", "n", F.get("v", 0).alias("fitness"))


def top_count(population: int) -> int:
    """How many of a population breed: a fifth, but enough for as many pairs as there are members."""
    n = int(population * 0.2)
    return n if n * n >= population else int(population**0.5) + 1


def next_generation(scores: list[float], population: list[list[list[float]]], seed: int = 1) -> list[list[list[float]]]:
    """Midpoints of centres of every ordered pair of the fittest, as many sets as there were, drawn at random.

    The size of a new set lies between its parents' sizes. The population is a
    parameter of the search and not of the data, so this runs on the driver.
    """
    top = sorted(range(len(scores)), key=lambda i: (scores[i], i))[: top_count(len(scores))]
    made = []
    for i, (a, b) in enumerate((population[a], population[b]) for a in top for b in top):
        rnd = random.Random(seed * 1_000_003 + i)
        low, high = sorted((len(a), len(b)))
        size = low + (rnd.randrange(high - low) if high > low else 0)
        made.append([[(x + y) / 2 for x, y in zip(rnd.choice(a), rnd.choice(b))] for _ in range(size)])
    return random.Random(seed).sample(made, min(len(population), len(made)))


def genetic_clustering(df: DataFrame, population: list[list[list[float]]], iterations: int, vec: str, seed: int = 1) -> list[list[list[float]]]:
    for i in range(iterations):
        scores = {r["cid"]: r["fitness"] for r in fitness(df, population, vec).collect()}
        population = next_generation([scores.get(c, 0.0) for c in range(len(population))], population, seed + i)
    return population
