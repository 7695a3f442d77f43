"""Components over the edges of all orders against a plain union-find."""

from __future__ import annotations

import random

import __spark_entry__ as entry
from warpline.operators import graph


def test_components_of_all_orders_equal_union_find(spark, sf):
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        a, b = sorted((find(r.o_orderkey), find(r.o_orderkey + 1 + r.o_custkey % 3)))
        parent[b] = a
    got = {r.id: r.label for r in entry.queries()["F5_connected_components"](spark, sf).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_rounds_write_in_proportion_to_the_edges(spark, monkeypatch):
    """A chain of mixed ids, and nodes whose only edge is a loop."""
    rows, save = [], graph.Scratch.save

    def noted(self, df, name):
        rows.append((out := save(self, df, name)).count())
        return out

    monkeypatch.setattr(graph.Scratch, "save", noted)
    ids = random.Random(5).sample(range(10_000), 600)
    chain = [*zip(ids, ids[1:]), (20_000, 20_000), (20_001, 20_001), (ids[0], ids[0]), (None, 7), (30_000, None)]
    got = {r.id: r.label for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {20_000: 20_000, 20_001: 20_001}
    assert sum(rows) < 8 * len(chain)
