"""Queries of the kernels: functional programs (D), generated kernels (E) and frame operators (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions import kernels as K
from warpline.functions import rowwise
from warpline.functions.vectors import f32, utf8_bytes, vseq, vsum
from warpline.operators.frame import cl, pair_cl
from warpline.plans import fixtures as X

R = "round({}, 6)"
#: Bytes of a batch that D29 widens to longs at once.
_BYTES_AT_ONCE = 1 << 20


def _scalar(df: DataFrame, places: int | None = 6) -> DataFrame:
    """Results as doubles or longs, rounded where sums may differ in their last bits."""
    kind = dict(df.dtypes)["v"]
    v = F.col("v").cast("long") if kind in ("int", "bigint") else F.col("v").cast("double")
    return df.withColumn("v", F.round(v, places) if kind in ("double", "float") and places is not None else v)


def _fields(df: DataFrame, **paths: str) -> DataFrame:
    """Struct members as columns: ints as longs, floats as rounded doubles."""
    keep = [c for c in df.columns if c != "v"]
    got = df.select(*keep, *[F.col(f"v.{p}").alias(n) for n, p in paths.items()])
    kinds = dict(got.dtypes)
    return got.select(*keep, *[F.col(n).cast("long").alias(n) if kinds[n] in ("int", "bigint") else F.round(F.col(n).cast("double"), 6).alias(n) for n in paths])


def _elements(df: DataFrame, array: str = "v") -> DataFrame:
    """A row for each element of an array, with its position."""
    keep = [c for c in df.columns if c != "v"]
    return df.select(*keep, F.posexplode(array).alias("pos", "x")).select(*keep, F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


_P = {"x": "x", "y": "y", "z": "z"}
_KP = {"k": "_1", "x": "_2.x", "y": "_2.y", "z": "_2.z"}
_AB = {"a": "_1", "b": "_2"}


def _map(fixture, *names: str, shape=_scalar):
    def run(spark: SparkSession, d: str) -> DataFrame:
        frame = cl(fixture(spark, d))
        for n in names:
            f, ddl = K.KERNELS[n]
            frame = frame.map(f, ddl)
        return shape(frame.df)

    return run


def _sql(fixture, select: str, tail: str = "") -> str:
    lead = "id, n, " if "lineitem" in X.SQL[fixture] else "id, "
    return f"WITH t AS ({X.SQL[fixture]}) SELECT {lead}{select} FROM t {tail}"


def _d(v: str) -> str:
    return f"round(({v})::DOUBLE, 6) AS v"


def _xyz(x: str, y: str, z: str) -> str:
    return ", ".join(f"round(({e})::FLOAT::DOUBLE, 6) AS {n}" for n, e in (("x", x), ("y", y), ("z", z)))


def _unnested(fixture, values: str, extra: str = "") -> str:
    """SQL of an array result: a row for each position."""
    return f"WITH t AS ({X.SQL[fixture]}), u AS (SELECT id, {extra}{values} AS xs FROM t), p AS (SELECT *, unnest(range(len(xs))) AS pos FROM u) SELECT * EXCLUDE (xs), round(xs[pos + 1]::DOUBLE, 6) AS x FROM p"


_SUM = "coalesce(list_sum(v), 0)"
_ROWS = "[0, 1, 2, 3, 4]"


def _fields_of(**paths):
    return lambda df: _fields(df, **paths)


def _sparse_rows(df: DataFrame) -> DataFrame:
    out = df.select("id", F.col("v.size").cast("long").alias("size"), F.posexplode(F.arrays_zip("v.indices", "v.values")).alias("pos", "e"))
    return out.select("id", "size", F.col("pos").cast("long").alias("pos"), F.col("e.indices").cast("long").alias("i"), F.col("e.values").alias("x"))


def _keyed_elements(df: DataFrame) -> DataFrame:
    out = df.select("id", F.col("v._1").cast("long").alias("k"), F.posexplode("v._2").alias("pos", "x"))
    return out.withColumn("pos", F.col("pos").cast("long"))


def _async_value(df: DataFrame) -> DataFrame:
    return _scalar(df.select("id", F.col("v.value").alias("v")))


def d22(spark, d):
    return _async_value(cl(X.doubles(spark, d)).map_async(lambda v: v).df)


def d23(spark, d):
    return _async_value(cl(X.doubles(spark, d)).flat_map_async(lambda v: v * v, lambda v: v * v).df)


def d28(spark, d):
    got = cl(X.doubles(spark, d)).map_async(lambda v: v, metadata=lambda v: v + 3.0).df
    return got.select("id", F.round("v.value", 6).alias("v"), F.round("v.metadata", 6).alias("m"))


def _async(fixture, name):
    return lambda spark, d: _async_value(cl(fixture(spark, d)).map_async(K.kernel(name)).df)


def d24(spark, d):
    """The prologue makes the size on its own; the kernel gets it captured."""
    frame = cl(X.vectors(spark, d)).map_async(lambda v, n: (vsum(v) + n) * 42.0, prologue=lambda v: {"n": F.size(v)})
    return _async_value(frame.df)


def d26(spark, d):
    return _elements(cl(X.ints(spark, d)).map_async(K.kernel("triples")).df, "v.value")


def d29(spark, d):
    """Whole partitions as Arrow streams."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            col = b.column(1)
            flat = col.flatten()
            at = col.offsets.to_numpy() - col.offsets[0].as_py()
            sums = np.zeros(len(col), dtype=np.int64)
            for begin in range(0, len(flat), _BYTES_AT_ONCE):
                x = flat.slice(begin, _BYTES_AT_ONCE).to_numpy(zero_copy_only=False).astype(np.int8)
                diff = (x + x).astype(np.int8).astype(np.int64) - x
                ends = np.cumsum(np.r_[0, diff])
                first, last = np.searchsorted(at, begin, "right") - 1, np.searchsorted(at, begin + len(x))
                cut = np.clip(at[first : last + 1] - begin, 0, len(x))
                sums[first:last] += ends[cut[1:]] - ends[cut[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums)], names=["id", "v"])

    return cl(X.byte_arrays(spark, d)).map_partitions_async(run, "id long, v long")


def d30(spark, d):
    """An inner parallel loop for each element."""

    def work(items, accel):
        import numpy as np

        for b in items:
            x = np.array(b, dtype=np.int64)
            yield int(accel(lambda i, x=x: 3 * (2 * x[i]), len(x)).sum())

    got = cl(X.byte_arrays(spark, d)).map_partitions_accel(work, "long")
    return got.select(F.col("value").alias("v"))


def d31(spark, d):
    frame = cl(X.keyed_vectors(spark, d).cache()).map(K.kernel("cached_row"))
    return _scalar(frame.df)


def d32(spark, d):
    v = X.vectors(spark, d)
    joined = v.join(v.select("id", F.col("v").alias("w")), "id").select("id", "v")
    return _elements(pair_cl(joined, "id").map_values(K.kernel("constant_range")).df)


def d15(spark, d):
    return _sparse_rows(cl(X.ints(spark, d)).map(K.kernel("sparse_steps")).df)


def e24(spark, d):
    return _sparse_rows(cl(X.ints(spark, d)).map(K.kernel("sparse_tens")).df)


def d34(spark, d):
    df = cl(X.floats(spark, d)).map(K.kernel("nested_vector")).df
    return df.select("id", "n", F.col("v._1").cast("long").alias("a"), F.col("v._2._1").cast("long").alias("b"), *[F.get("v._2._2", F.lit(i)).alias(f"x{i}") for i in range(3)])


def a3_arrow(spark, d):
    """The Arrow engine of the vector sum; ``native`` must agree."""
    import numpy as np
    import pyarrow as pa

    def batch(col):
        flat = col.flatten().to_numpy(zero_copy_only=False)
        at = col.offsets.to_numpy() - col.offsets[0].as_py()
        total = np.r_[0.0, np.cumsum(flat)]
        return pa.array(total[at[1:]] - total[at[:-1]])

    return _scalar(cl(X.vectors(spark, d), engine="arrow").map(K.kernel("vector_sum"), "double", batch=batch).df)


def a10(spark, d):
    from warpline.operators.frame import index_map

    return _elements(cl(X.ints(spark, d)).map(lambda v: index_map(v, lambda i: (i * v).cast("double"))).df)


def e39(spark, d):
    """Seed extension over words of part names, types and brands, as symbols 0-4."""
    t = X.table(spark, d, "part")
    symbols = lambda c: F.transform(utf8_bytes(F.col(c)), lambda b: F.pmod(b.cast("int"), F.lit(5)))
    rows = t.select(F.col("p_partkey").alias("id"), symbols("p_name").alias("left_q"), symbols("p_type").alias("left_r"), symbols("p_brand").alias("right_q"), symbols("p_name").alias("right_r"))
    return rowwise.extensions(rows, "id")


def e40(spark, d):
    """Byte mixing of 16 bytes made of each part's md5."""
    t = X.table(spark, d, "part")
    bytes_ = F.transform(F.regexp_extract_all(F.md5("p_name"), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))
    out = rowwise.mixed_bytes(t.select(F.col("p_partkey").alias("id"), bytes_.alias("b")), "id", "b", list(range(32)))
    return out.select("id", F.posexplode("out").alias("pos", "x"))


def _options(log_ratio):
    def run(spark, d):
        c = lambda n: f32(F.col(n))
        put = F.when(F.col("l_linenumber") % 2 == 0, F.lit(0)).otherwise(F.lit(1))
        spot = f32(c("l_extendedprice") / f32(1000))
        v = K.option_price(spot, c("l_quantity") + f32(20), c("l_tax") + f32(0.01), c("l_discount") + f32(0.1), f32(F.col("l_linenumber")), put, log_ratio)
        return X._line(spark, d, F.round(v, 6))

    return run


def _options_sql(log_ratio: bool) -> str:
    ratio = "ln(s / k)" if log_ratio else "s / k"

    def cdf(x: str) -> str:
        k = f"(1::DOUBLE / (1::DOUBLE + 0.2316419::DOUBLE * abs({x})))"
        p = [k]
        for _ in range(4):
            p.append(f"({p[-1]} * {k})")
        rest = f"({p[1]} * (-0.356563782)::DOUBLE)"
        for q, c in zip(p[2:], ("1.781477937", "(-1.821255978)", "1.330274429")):
            rest = f"({rest} + {q} * {c}::DOUBLE)"
        upper = f"(1::DOUBLE - ({rest} + {k} * 0.319381530::DOUBLE) * (exp((-0.5)::DOUBLE * {x} * {x}) * 0.39894228040143270286::DOUBLE))"
        return f"(CASE WHEN {x} < 0 THEN 1::DOUBLE - {upper} ELSE {upper} END)"

    return f"""
WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, (l_extendedprice::FLOAT / 1000::FLOAT)::FLOAT::DOUBLE AS s, (l_quantity::FLOAT + 20::FLOAT)::FLOAT::DOUBLE AS k,
  (l_tax::FLOAT + 0.01::FLOAT)::FLOAT::DOUBLE AS r, (l_discount::FLOAT + 0.1::FLOAT)::FLOAT::DOUBLE AS vol, l_linenumber::DOUBLE AS tm, l_linenumber % 2 AS put FROM lineitem),
e AS (SELECT *, (r + vol * vol * 0.5::DOUBLE) * tm + {ratio} AS num, vol * sqrt(tm) AS spread FROM t),
q AS (SELECT *, num / spread AS d1, num / spread - spread AS d2, k * exp(-r * tm) AS f FROM e),
c AS (SELECT *, {cdf("d1")} AS n1, {cdf("d2")} AS n2 FROM q)
SELECT id, n, round(CASE WHEN put = 0 THEN s * n1 - f * n2 ELSE f * (1::DOUBLE - n2) - s * (1::DOUBLE - n1) END, 6) AS v FROM c"""


_TRIPLE = "x + 3::FLOAT + y + z"
_SIX = "list_sum(list_transform(v, lambda b: 6 * b))"
_WRAP = "list_sum(list_transform(v, lambda b: ((2 * b + 128 + 256) % 256 - 128) - b))"

#: name -> (query, DuckDB SQL or None)
QUERIES: dict = {
    "A3_map_arrow": (a3_arrow, _sql(X.vectors, _d(_SUM))),
    "A4_pair_map": (lambda s, d: _scalar(pair_cl(X.keyed_floats(s, d).select("id", "n", F.col("v._1").alias("k"), F.col("v._2").alias("v"))).map_pairs(lambda k, v: f32(k) + v).df.drop("k")), _sql(X.keyed_floats, _d("k::FLOAT + v"))),
    "A5_map_values": (lambda s, d: _scalar(pair_cl(X.doubles(s, d), "id").map_values(lambda v: v * 2).df), _sql(X.doubles, _d("v * 2"))),
    "A7_flat_map_array": (lambda s, d: _scalar(cl(X.ints(s, d)).flat_map_array(lambda v: vseq(v + 1)).df), "SELECT p_partkey AS id, unnest(range(p_size + 1))::BIGINT AS v FROM part"),
    "A10_index_map": (a10, _unnested(X.ints, "list_transform(range(v), lambda i: i * v)")),
    "D1_prim_input_prim_output": (_map(X.doubles, "square_times", "twice"), _sql(X.doubles, _d("(v * v * 4) * 2"))),
    "D2_object_input_object_output": (_map(X.points, "point_product", shape=_fields_of(**_P)), _sql(X.points, _xyz("x * y * z * 4::FLOAT * 4::FLOAT", "y", "z"))),
    "D3_tuple_input": (_map(X.keyed_points, "keyed_point_sum"), _sql(X.keyed_points, "round(((k::FLOAT + (x + y + z)) + 4::FLOAT + 3::FLOAT)::DOUBLE, 6) AS v")),
    "D4_tuple_input_prim": (_map(X.float_doubles, "float_double_sum"), _sql(X.float_doubles, _d("a::DOUBLE + b + 4 + 4"))),
    "D5_tuple_output": (_map(X.floats, "float_to_point", shape=_fields_of(k="_1", x="_2.x", y="_2.y", z="_2.z")), _sql(X.floats, "round(v::DOUBLE, 6) AS k, 5.0::DOUBLE AS x, round(v::DOUBLE, 6) AS y, 3.0::DOUBLE AS z")),
    "D6_tuple_output_prim": (_map(X.floats, "float_to_double", shape=_fields_of(**_AB)), _sql(X.floats, "round(v::DOUBLE, 6) AS a, round(v::DOUBLE + 12, 6) AS b")),
    "D7_tuple_prim_input_output": (_map(X.int_pairs, "swap", shape=_fields_of(**_AB)), _sql(X.int_pairs, "b::BIGINT AS a, a::BIGINT AS b")),
    "D8_tuple_input_output": (_map(X.keyed_floats, "keyed_to_point", shape=_fields_of(**_KP)), _sql(X.keyed_floats, "k::BIGINT AS k, " + _xyz("v + 5::FLOAT", "v + 2::FLOAT", "v + 7::FLOAT"))),
    "D9_broadcast_var": (_map(X.ints, "broadcast_sum"), _sql(X.ints, "(v + 15)::BIGINT AS v")),
    "D10_broadcast_dense": (_map(X.ints, "broadcast_dense"), _sql(X.ints, f"({_ROWS})[v % 5 + 1]::DOUBLE AS v")),
    "D11_broadcast_sparse": (_map(X.ints, "broadcast_sparse"), _sql(X.ints, f"({_ROWS})[1] + (v % 5)::DOUBLE AS v")),
    "D12_dense_vector_input": (_map(X.vectors, "vector_sum"), _sql(X.vectors, _d(_SUM))),
    "D13_dense_vector_output": (_map(X.ints, "range_vector", shape=_elements), _unnested(X.ints, "range(v)")),
    "D14_sparse_vector_input": (_map(X.sparse_vectors, "sparse_sums", shape=_fields_of(**_AB)), _sql(X.sparse_vectors, "coalesce(list_sum(i), 0)::BIGINT AS a, round(coalesce(list_sum(w), 0), 6) AS b")),
    "D15_sparse_vector_output": (d15, "SELECT id, v AS size, pos, v * pos AS i, (v * 2 * pos)::DOUBLE AS x FROM (SELECT p_partkey AS id, p_size::BIGINT AS v, unnest(range(p_size)) AS pos FROM part)"),
    "D16_tuple_dense_input": (_map(X.keyed_vectors, "keyed_first_three"), _sql(X.keyed_vectors, _d("k + v[1] + v[2] + v[3]"))),
    "D17_tuple_dense_output": (_map(X.ints, "int_with_range", shape=_keyed_elements), "SELECT p_partkey AS id, p_size::BIGINT AS k, unnest(range(p_size)) AS pos, unnest(range(p_size))::DOUBLE AS x FROM part"),
    "D18_two_dense_vector_input": (_map(X.two_vectors, "two_vector_sum"), _sql(X.two_vectors, _d("list_sum(list_transform(v, lambda x: x + x * 2))"))),
    "D19_array_input": (_map(X.vectors, "vector_sum"), _sql(X.vectors, _d(_SUM))),
    "D20_array_output": (_map(X.ints, "range_vector", shape=_elements), _unnested(X.ints, "range(v)")),
    "D21_byte_array_input": (_map(X.byte_arrays, "byte_sum"), _sql(X.byte_arrays, "list_sum(v)::BIGINT AS v")),
    "D22_map_async": (d22, _sql(X.doubles, _d("v"))),
    "D23_flat_map_async": (d23, _sql(X.doubles, _d("unnest([v * v, v * v])"))),
    "D24_map_async_array_input": (d24, _sql(X.vectors, _d(f"({_SUM} + len(v)) * 42"))),
    "D25_map_async_multi_array_input": (_async(X.vectors, "less_position"), _sql(X.vectors, _d("list_sum(list_transform(v, lambda x, i: x - (i - 1))) * 42"))),
    "D26_map_async_array_output": (d26, _unnested(X.ints, "list_transform(range(v), lambda i: i * 3.0)")),
    "D27_map_async_byte_array_input": (_async(X.byte_arrays, "wrapped_bytes"), _sql(X.byte_arrays, f"{_WRAP}::BIGINT AS v")),
    "D28_map_async_metadata": (d28, _sql(X.doubles, "round(v, 6) AS v, round(v + 3.0, 6) AS m")),
    "D29_map_partitions_async": (d29, _sql(X.byte_arrays, f"{_WRAP}::BIGINT AS v")),
    "D30_map_partitions_parallel": (d30, f"WITH t AS ({X.SQL[X.byte_arrays]}) SELECT {_SIX}::BIGINT AS v FROM t"),
    "D31_caching": (d31, _sql(X.keyed_vectors, _d("(k % 5) * (k % 5) + v[1] + v[2] + v[3] + v[4] + v[5]"))),
    "D32_map_values": (d32, "SELECT vec_id AS id, unnest(range(5)) AS pos, unnest(range(5))::DOUBLE AS x FROM embeddings"),
    "D33_nested_tuple2": (_map(X.floats, "nested", shape=_fields_of(a="_1", b="_2._1", c="_2._2")), _sql(X.floats, "trunc(v)::BIGINT AS a, round(v::DOUBLE, 6) AS b, round(v::DOUBLE + 12, 6) AS c")),
    "D34_nested_tuple2_dense": (d34, _sql(X.floats, "trunc(v)::BIGINT AS a, 2 * trunc(v)::BIGINT AS b, v::DOUBLE AS x0, v::DOUBLE + 1 AS x1, v::DOUBLE + 3 AS x2")),
    "E1_primitive": (_map(X.ints, "plus3"), _sql(X.ints, "(v + 3)::BIGINT AS v")),
    "E2_primitive_to_object": (_map(X.ints, "int_to_point", shape=_fields_of(**_P)), _sql(X.ints, _xyz("v + 1", "v + 2", "v + 3"))),
    "E3_object": (_map(X.points, "point_shift", shape=_fields_of(**_P)), _sql(X.points, _xyz("x + 1::FLOAT", "y + 2::FLOAT", "z + 3::FLOAT"))),
    "E4_external_array": (_map(X.ints, "plus_captured"), _sql(X.ints, "(v + 6)::BIGINT AS v")),
    "E5_external_objects": (_map(X.ints, "plus_points"), _sql(X.ints, "(v + 0 + 4 + 8)::DOUBLE AS v")),
    "E6_external_scalar": (_map(X.ints, "plus4"), _sql(X.ints, "(v + 4)::BIGINT AS v")),
    "E7_external_function": (_map(X.points, "mutated_point", shape=_fields_of(**_P)), _sql(X.points, _xyz("x + 4::FLOAT", "y + 4::FLOAT", "z + 4::FLOAT"))),
    "E8_class_function": (_map(X.ints, "outer_plus3"), _sql(X.ints, "(v + 3)::BIGINT AS v")),
    "E9_tuple_input": (_map(X.int_pairs, "pair_sum"), _sql(X.int_pairs, "(a + b)::BIGINT AS v")),
    "E10_tuple_object_input": (_map(X.keyed_points, "point_sum"), _sql(X.keyed_points, _d("(x + y + z)::FLOAT"))),
    "E11_tuple_object_direct": (_map(X.keyed_points, "point_sum"), _sql(X.keyed_points, _d("(x + y + z)::FLOAT"))),
    "E12_tuple_to_function": (_map(X.int_pairs, "first_plus3"), _sql(X.int_pairs, "(a + 3)::BIGINT AS v")),
    "E13_object_to_function": (_map(X.keyed_points, "point_sum_plus3"), _sql(X.keyed_points, _d("((x + 3::FLOAT) + (y + z))::FLOAT"))),
    "E14_object_direct_to_function": (_map(X.keyed_points, "point_sum_plus3"), _sql(X.keyed_points, _d("((x + 3::FLOAT) + (y + z))::FLOAT"))),
    "E15_tuple_output": (_map(X.ints, "int_to_pair", shape=_fields_of(**_AB)), _sql(X.ints, "(v + 1)::BIGINT AS a, (v + 2)::DOUBLE AS b")),
    "E16_tuple_object_output": (_map(X.ints, "int_to_point_pair", shape=_fields_of(**_KP)), _sql(X.ints, "(v + 1)::BIGINT AS k, 1.0::DOUBLE AS x, 2.0::DOUBLE AS y, 3.0::DOUBLE AS z")),
    "E17_tuple_input_output": (_map(X.keyed_floats, "keyed_shift", shape=_fields_of(**_KP)), _sql(X.keyed_floats, "k::BIGINT AS k, " + _xyz("v + 1::FLOAT", "v + 2::FLOAT", "v + 3::FLOAT"))),
    "E18_nearest_centre": (_map(X.points, "nearest_centre"), _sql(X.points, "(list_position(d, list_min(d)) - 1)::BIGINT AS v", "").replace("FROM t ", "FROM (SELECT *, [" + ", ".join(f"(x::DOUBLE - {a})^2 + (y::DOUBLE - {b})^2 + (z::DOUBLE - {c})^2" for a, b, c in K.UNIT_CENTRES) + "] AS d FROM t)")),
    "E19_dense_input": (_map(X.vectors, "vector_sum"), _sql(X.vectors, _d(_SUM))),
    "E20_sparse_input": (_map(X.sparse_vectors, "sparse_sums", shape=_fields_of(**_AB)), _sql(X.sparse_vectors, "coalesce(list_sum(i), 0)::BIGINT AS a, round(coalesce(list_sum(w), 0), 6) AS b")),
    "E21_sparse_assign": (_map(X.sparse_vectors, "sparse_first", shape=_fields_of(**_AB)), _sql(X.sparse_vectors, "i[1]::BIGINT AS a, round(w[1], 6) AS b")),
    "E22_array_alloc": (_map(X.ints, "alloc_plus3"), _sql(X.ints, "(v + 3)::BIGINT AS v")),
    "E23_dense_output": (_map(X.ints, "doubled_range", shape=_elements), _unnested(X.ints, "list_transform(range(v), lambda i: 2 * i)")),
    "E24_sparse_output": (e24, "SELECT id, v AS size, pos, 10 * v AS i, (20 * v)::DOUBLE AS x FROM (SELECT p_partkey AS id, p_size::BIGINT AS v, unnest(range(p_size)) AS pos FROM part)"),
    "E25_array_broadcast": (_map(X.ints, "lookup"), _sql(X.ints, "(v % 5 + 1)::BIGINT AS v")),
    "E26_dense_broadcast": (_map(X.ints, "dense_diagonal"), _sql(X.ints, "(v + 10)::DOUBLE AS v")),
    "E27_sparse_broadcast": (_map(X.ints, "sparse_diagonal"), _sql(X.ints, "(v + 20)::DOUBLE AS v")),
    "E28_computed_index": (_map(X.indexed_vectors, "computed_index"), _sql(X.indexed_vectors, _d("v[k - len(v) - 4 + 1]"))),
    "E29_tuple_dense_output": (_map(X.ints, "int_filled", shape=_keyed_elements), "SELECT p_partkey AS id, p_size::BIGINT AS k, unnest(range(p_size)) AS pos, p_size::DOUBLE AS x FROM part"),
    "E30_tuple_broadcast": (_map(X.ints, "pair_lookup"), _sql(X.ints, "((v % 5 + 1) + (5 - v % 5))::BIGINT AS v")),
    "E31_tuple_object_broadcast": (_map(X.ints, "vector_lookup"), _sql(X.ints, "((v % 5 + 1) + v % 5)::BIGINT AS v")),
    "E32_array_input": (_map(X.vectors, "vector_sum"), _sql(X.vectors, _d(_SUM))),
    "E33_array_output": (_map(X.ints, "doubled_range", shape=_elements), _unnested(X.ints, "list_transform(range(v), lambda i: 2 * i)")),
    "E34_byte_input": (_map(X.byte_arrays, "byte_sum"), _sql(X.byte_arrays, "list_sum(v)::BIGINT AS v")),
    "E35_async_map": (_async(X.ints, "five_times"), _sql(X.ints, "(v * 5)::BIGINT AS v")),
    "E36_async_array_input": (_async(X.vectors, "vector_sum"), _sql(X.vectors, _d(_SUM))),
    "E37_async_array_output": (lambda s, d: _elements(cl(X.ints(s, d)).map_async(K.kernel("first_only")).df, "v.value"), _unnested(X.ints, "list_transform(range(v), lambda i: CASE WHEN i = 0 THEN v ELSE 0 END)")),
    "E38_async_byte_products": (_async(X.byte_pairs, "byte_products"), _sql(X.byte_pairs, "list_sum(list_transform(v, lambda b: b * b))::BIGINT AS v")),
    "E39_seed_extension": (e39, None),
    "E40_byte_mixing": (e40, None),
    "E41_option_price": (_options(False), _options_sql(False)),
    "E41_option_price_log": (_options(True), _options_sql(True)),
    "E42_rank_share": (_map(X.rank_links, "rank_share"), _sql(X.rank_links, "round((a / b::FLOAT)::FLOAT::DOUBLE, 6) AS v")),
}
