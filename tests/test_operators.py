"""Hand-checkable cases and edges of the operators."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from warpline.operators import clustering, etl, graph, keyed, nbody, network
from warpline.operators.frame import cl, pair_cl
from warpline.plans import kernel_queries


def test_async_value_and_metadata(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    got = cl(df).map_async(lambda v: v, metadata=lambda v: v + 3).df.select("v.*").first()
    assert tuple(got) == (1.0, 4.0)


def test_flat_map_gives_a_row_for_each_spawn_and_needs_one(spark):
    df = spark.createDataFrame([(3.0,)], "v double")
    assert [r[0].value for r in cl(df).flat_map_async(lambda v: v * v, lambda v: v * v).df.collect()] == [9.0, 9.0]
    with pytest.raises(ValueError):
        cl(df).flat_map_async()


def test_pairs_keep_keys_and_frames_pass_through(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    assert pair_cl(df).map_values(lambda v: v + 1).df.collect() == [(1, 3.0)]
    assert cl(df).where("v > 5").count() == 0


def test_pagerank_step_keeps_nodes_without_in_links(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "dst long, src long")
    nodes = spark.createDataFrame([(0, 4.0, 2), (1, 2.0, 1), (2, 9.0, 1)], "id long, rank double, links long")
    assert [r.rank for r in graph.pagerank(edges, nodes, 1).orderBy("id").collect()] == [4.0, 2.0, 4.0]


def test_components(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert [r.label for r in graph.connected_components(edges).orderBy("id").collect()] == [0, 0, 0, 3, 3]
    assert graph.connected_components(edges.limit(0)).count() == 0


def test_index_sample_and_copies(spark):
    df = spark.range(100).repartition(7)
    got = keyed.zip_with_index(df, ["id"]).collect()
    assert all(r.id == r.idx for r in got) and len(got) == 100
    assert keyed.take_sample(df, 10, 1, ["id"]).collect() == keyed.take_sample(df, 10, 1, ["id"]).collect()
    assert sorted(r.id for r in etl.even_copies(spark.range(3), 2, "id").collect()) == [0, 1, 2, 3, 4, 5]


def test_downsample_takes_the_first_of_each_k(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],), ([],)], "v array<double>")
    assert [r.v for r in etl.downsample(df, "v", 2).collect()] == [[1.0, 3.0, 5.0], []]


def test_kmeans_engines_agree_and_empty_centres_stay(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    start = [[0.0, 0.0], [4.0, 2.0], [100.0, 100.0]]
    a = clustering.kmeans(df, 3, 2, "v", "id", start)
    b = clustering.kmeans(df, 3, 2, "v", "id", start, engine="native")
    assert np.allclose(a, b) and a[2] == start[2]


def test_two_bodies_repel_and_one_place_adds_nothing(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 1.0), (2, 2.0, 0.0, 0.0, 1.0)], "id long, x float, y float, z float, mass float")
    pairs = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "target long, actor long")
    got = {r.id: r.ax for r in nbody.accelerations(points, pairs).collect()}
    assert got == {0: -0.25, 1: 0.25}


def test_gradients_are_those_of_the_loss(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 4)), np.eye(3)[rng.integers(0, 3, 6)]
    w = network.new_weights([4, 5, 3])
    loss = lambda: 0.5 * ((network.forward(x, w)[-1] - y) ** 2).sum()
    grad = network.gradients(x, y, w)
    for k in range(2):
        w[k][0][1, 2] += 1e-6
        up = loss()
        w[k][0][1, 2] -= 2e-6
        down = loss()
        w[k][0][1, 2] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][0][1, 2]) < 1e-6


def test_bodies_are_not_broadcast(spark, monkeypatch):
    """Points and accelerations are as many as the bodies, whatever Spark's estimate of their files."""
    plans, save = [], nbody.Scratch.save
    monkeypatch.setattr(nbody.Scratch, "save", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or save(self, df, name))
    points = spark.range(50).selectExpr("id", "float(id) x", "float(id % 7) y", "float(id % 3) z", "float(1) mass")
    pairs = spark.range(49).selectExpr("id target", "id + 1 actor")
    assert nbody.simulate(points, pairs, 2).count() == 50
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_accelerations_of_parts_are_not_broadcast(spark, sf):
    import __spark_entry__ as entry

    df = entry.queries()["F6_nbody_accelerations"](spark, sf)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


class _Held:
    """A frame that gives back the function over its partitions."""

    columns = ["v"]
    select = lambda self, *_: self
    mapInArrow = map_partitions_async = lambda self, f, _: f


def _byte_rows(sizes):
    ends = np.r_[0, np.cumsum(sizes)]
    data = np.random.default_rng(1).integers(-128, 128, ends[-1]).astype(np.int8)
    rows = [data[a:b].astype(int) for a, b in zip(ends, ends[1:])]
    return rows, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data))


def _peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_bytes_of_a_batch_are_widened_in_pieces(monkeypatch):
    monkeypatch.setattr(kernel_queries, "cl", lambda _: _Held())
    monkeypatch.setattr(kernel_queries.X, "byte_arrays", lambda *_: None)
    rows, v = _byte_rows([0, 5, 0, 3 << 20, 1 << 20, 0, *[10_007] * 800, 0])
    f, skip = kernel_queries.d29(None, None), 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(v))), v], names=["id", "v"]).slice(skip)
    got, peak = _peak(lambda: list(f(iter([batch, batch.slice(0, 0)]))))
    assert got[0].column(1).to_pylist() == [int((((2 * r + 128) % 256 - 128) - r).sum()) for r in rows[skip:]]
    assert got[1].num_rows == 0 and peak < 60


def test_an_inner_loop_holds_one_element_as_objects(spark):
    rows, v = _byte_rows([50_000] * 40)
    f = cl(_Held()).map_partitions_accel(lambda items, accel: (sum(x) for x in items), "long")
    got, peak = _peak(lambda: list(f(iter([pa.RecordBatch.from_arrays([v], names=["v"])]))))
    assert got[0].column(0).to_pylist() == [int(r.sum()) for r in rows]
    assert peak < 8


def test_crop_computes_an_image_once(spark):
    rows = [(1, 2, 3, 3, bytes(range(240, 256)) + b"\x00\x01"), (2, 2, 2, 3, b"\x07\x08\x09"), (3, 2, 2, 3, None), (4, 1, 2, 3, b"abcdef"), (5, 2, 2, -1, b"abcdef")]
    images = spark.createDataFrame(rows, "id int, height int, width int, channels int, data binary")
    got = etl.crop_rgb(images.withColumn("data", F.unhex(F.hex("data"))), 2, 2)
    assert {r.id: r.v for r in got.collect()} == {
        1: [242, 241, 240, 245, 244, 243, 251, 250, 249, 254, 253, 252],
        2: [9, 8, 7, *[None] * 9],
        3: [None] * 12,
        5: [99, 98, 97, 98, 97, None, 97, None, None, None, None, None],
    }
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan.split("lambdafunction")[0]
