"""Array columns as vectors: sums, distances, sequences, sparse structs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType

#: Canonical types.
VEC = "array<double>"
POINT3 = "struct<x:float,y:float,z:float>"
POINT4 = "struct<x:float,y:float,z:float,mass:float>"
SPARSE = "struct<size:int,indices:array<int>,values:array<double>>"
BYTES = "array<tinyint>"


def f32(x: Column | float | int) -> Column:
    """A 32-bit float: ``float op int`` would widen to double otherwise."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def vsum(v: Column, zero: str = "double") -> Column:
    """Sum of the elements, from left to right; 0 for an empty vector."""
    return F.aggregate(v, F.lit(0).cast(zero), lambda a, x: a + x.cast(zero))


def vseq(n: Column) -> Column:
    """``[0, 1, ..., n - 1]`` as ints; empty for ``n <= 0``."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0))), lambda i: i < n)


def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vscale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def vdot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def vdist2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return vsum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def vdist(a: Column, b: Column) -> Column:
    return F.sqrt(vdist2(a, b))


def vdownsample(v: Column, k: int) -> Column:
    """Every ``k``-th element from the first: ceil(n / k) of them."""
    return F.filter(v, lambda _, i: i % k == 0)


def literal(values: list[float]) -> Column:
    """A constant vector; it is parsed once and folded into the plan."""
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in values) + "]"), VEC)


def literal_rows(rows: list[list[float]]) -> Column:
    """A constant array of vectors."""
    return F.from_json(F.lit("[" + ",".join("[" + ",".join(repr(float(x)) for x in r) + "]" for r in rows) + "]"), "array<array<double>>")


def nearest(v: Column, centres: Column) -> Column:
    """``struct(d2, id)`` of the nearest of an array of centres; of equal distances the lowest id."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(vdist2(v, c).alias("d2"), i.alias("id"))))


def to_sparse(v: Column) -> Column:
    """The positive elements as a sparse struct."""
    at = F.filter(vseq(F.size(v)), lambda i: F.get(v, i) > 0)
    return F.struct(F.size(v).alias("size"), at.alias("indices"), F.transform(at, lambda i: F.get(v, i)).alias("values"))


def sparse(size: Column, indices: Column, values: Column) -> Column:
    """A sparse struct as given; indices may be unsorted, repeated or out of range."""
    return F.struct(size.cast("int").alias("size"), indices.alias("indices"), values.alias("values"))


def to_byte(x: Column) -> Column:
    """The low eight bits as a signed byte, wrapping as two's complement does."""
    return (F.pmod(x.cast("long") + 128, F.lit(256)) - 128).cast("tinyint")


@F.arrow_udf(ArrayType(ByteType()))
def _signed_bytes(text: pa.Array) -> pa.Array:
    data = text.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data.buffers()[2], dtype=np.int8) if data.buffers()[2] is not None else np.zeros(0, dtype=np.int8)
    values = pa.array(whole[ends[0] : ends[-1]], pa.int8())
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), values, mask=data.is_null())


def utf8_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as signed bytes; the batches' buffers are taken as they are."""
    return _signed_bytes(text)
