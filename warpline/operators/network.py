"""A feed-forward sigmoid network with backpropagation, batch by batch in NumPy.

Weights are model parameters, sent to the tasks; each batch of rows is a few
matrix products, and only its gradient sums leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.operators.clustering import matrix
from warpline.operators.keyed import vector_sum_by_key

Weights = list[tuple[np.ndarray, np.ndarray]]


def new_weights(layers: list[int], seed: int = 1) -> Weights:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, 1 / np.sqrt(a), (b, a)), np.zeros(b)) for a, b in zip(layers, layers[1:])]


def forward(x: np.ndarray, weights: Weights) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    out = [x]
    for w, b in weights:
        out.append(1 / (1 + np.exp(-(out[-1] @ w.T + b))))
    return out


def gradients(x: np.ndarray, y: np.ndarray, weights: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summed weight and bias gradients of half the squared error, layer by layer."""
    a = forward(x, weights)
    delta = (a[-1] - y) * a[-1] * (1 - a[-1])
    out = []
    for k in reversed(range(len(weights))):
        out.append((delta.T @ a[k], delta.sum(axis=0)))
        if k:
            delta = (delta @ weights[k][0]) * a[k] * (1 - a[k])
    return out[::-1]


def predict(df: DataFrame, weights: Weights, vec: str, id_: str) -> DataFrame:
    """``(id, out array<double>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = forward(matrix(b.column(1)), weights)[-1] if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", "out"])

    return df.select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, "id long, out array<double>")


def gradient_table(df: DataFrame, weights: Weights, vec: str, label: str) -> DataFrame:
    """``(layer, g array<double>)``: weight rows then biases of each layer, summed over ``df``; labels are class numbers."""
    classes = len(weights[-1][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = gradients(matrix(b.column(0)), np.eye(classes)[b.column(1).to_numpy()], weights)
                flat = [np.r_[w.ravel(), c] for w, c in g]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["layer", "g"])

    part = df.select(F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).mapInArrow(run, "layer int, g array<double>")
    return vector_sum_by_key(part, ["layer"], "g")


def train(df: DataFrame, layers: list[int], iterations: int, rate: float, vec: str, label: str, apply_update: bool = True, seed: int = 1) -> Weights:
    """Full-batch gradient steps; with ``apply_update=False`` gradients are computed and weights stay."""
    weights = new_weights(layers, seed)
    n = df.count()
    for _ in range(iterations):
        got = {r["layer"]: np.array(r["g"]) for r in gradient_table(df, weights, vec, label).collect()}
        if apply_update and got:
            weights = [(w - rate * got[k][: w.size].reshape(w.shape) / n, b - rate * got[k][w.size :] / n) for k, (w, b) in enumerate(weights)]
    return weights
