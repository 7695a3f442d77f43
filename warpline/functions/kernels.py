"""The scalar, struct and array kernels, by name.

Each takes the element column (or struct) and gives a column. ``KERNELS`` maps a
name to (function, DDL of its result).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warpline.functions.vectors import POINT3, SPARSE, VEC, f32, literal_rows, nearest, sparse, to_byte, vadd, vseq, vsum

#: Captured scalars, points and broadcast arrays of the kernels.
M = 4.0
POINTS = [(0.0, 1.0, 2.0), (3.0, 4.0, 5.0), (6.0, 7.0, 8.0)]
INTS = [1, 2, 3, 4, 5]
DOUBLES = [2.0, 3.0, 4.0]
ROWS = [[0.0, 1.0, 2.0, 3.0, 4.0]] * 5
STEPPED = [[float(i * j) for j in range(5)] for i in range(5)]
UNIT_CENTRES = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.0]]


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(f32(x).alias("x"), f32(y).alias("y"), f32(z).alias("z"))


def pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("_1"), b.alias("_2"))


def _lit2(rows: list[list[float]]) -> Column:
    return literal_rows(rows)


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def _at(c: Column, i: Column | int) -> Column:
    return F.get(c, i if isinstance(i, Column) else F.lit(i))


def _floats(v: Column) -> Column:
    """``[0.0, 1.0, ..., v - 1]``."""
    return F.transform(vseq(v), lambda i: i.cast("double"))


def _filled(n: Column, x: Column) -> Column:
    return F.transform(vseq(n), lambda _: x)


def _plus3(p: Column) -> Column:
    return p["x"] + f32(3)


def _xyz(p: Column) -> Column:
    return p["x"] + p["y"] + p["z"]


def _shifted(p: Column, by: int) -> Column:
    return point(p["x"] + f32(by), p["y"] + f32(by), p["z"] + f32(by))


def _doubled_less(b: Column) -> Column:
    """Sum of (2b wrapped to a byte) - b."""
    return F.aggregate(b, F.lit(0), lambda a, x: a + to_byte(x.cast("int") * 2).cast("int") - x.cast("int"))


def _row_stat(v: Column) -> Column:
    return _at(_at(_lit2(ROWS), v % 5), v % 5)


class Outer:
    """An object whose method a kernel calls."""

    def __init__(self, by: int) -> None:
        self.by = by

    def extern(self, v: Column) -> Column:
        return v + F.lit(self.by)


KERNELS: dict = {
    # functional programs
    "square_times": (lambda v: v * v * M, "double"),
    "twice": (lambda v: v + v, "double"),
    "point_product": (lambda p: point(p["x"] * p["y"] * p["z"] * f32(M) * f32(POINTS[1][1]), p["y"], p["z"]), POINT3),
    "keyed_point_sum": (lambda t: f32(t["_1"]) + _xyz(t["_2"]) + f32(M) + f32(POINTS[1][0]), "float"),
    "float_double_sum": (lambda t: t["_1"].cast("double") + t["_2"] + DOUBLES[2] + M, "double"),
    "float_to_point": (lambda v: pair(v, point(f32(1 + M), v, f32(3))), f"struct<_1:float,_2:{POINT3}>"),
    "float_to_double": (lambda v: pair(v, v.cast("double") + 12.0), "struct<_1:float,_2:double>"),
    "swap": (lambda t: pair(t["_2"], t["_1"]), "struct<_1:int,_2:int>"),
    "keyed_to_point": (lambda t: pair(t["_1"], point(t["_2"] + f32(1) + f32(M), t["_2"] + f32(2) + f32(POINTS[0][0]), t["_2"] + f32(3) + f32(POINTS[1][1]))), f"struct<_1:int,_2:{POINT3}>"),
    "broadcast_sum": (lambda v: v + F.aggregate(_ints(INTS), F.lit(0), lambda a, x: a + x), "int"),
    "broadcast_dense": (_row_stat, "double"),
    "broadcast_sparse": (lambda v: _at(_at(_lit2(ROWS), v % 5), 0) + (v % 5).cast("double"), "double"),
    "vector_sum": (vsum, "double"),
    "range_vector": (_floats, VEC),
    "sparse_sums": (lambda s: pair(vsum(s["indices"], "int"), vsum(s["values"])), "struct<_1:int,_2:double>"),
    "sparse_steps": (lambda v: sparse(v, F.transform(vseq(v), lambda i: v * i), F.transform(vseq(v), lambda i: (v * 2 * i).cast("double"))), SPARSE),
    "keyed_first_three": (lambda t: t["_1"].cast("double") + _at(t["_2"], 0) + _at(t["_2"], 1) + _at(t["_2"], 2), "double"),
    "int_with_range": (lambda v: pair(v, _floats(v)), f"struct<_1:int,_2:{VEC}>"),
    "two_vector_sum": (lambda t: vsum(vadd(t["_1"], t["_2"])), "double"),
    "byte_sum": (lambda b: vsum(b, "int"), "int"),
    "less_position": (lambda v: vsum(F.transform(v, lambda x, i: x - i)) * 42.0, "double"),
    "triples": (lambda v: F.transform(vseq(v), lambda i: i * 3.0), VEC),
    "wrapped_bytes": (_doubled_less, "int"),
    "cached_row": (lambda t: _at(_at(_lit2(STEPPED), t["_1"] % 5), t["_1"] % 5) + vsum(F.slice(t["_2"], 1, 5)), "double"),
    "constant_range": (lambda v: _floats(F.lit(5)), VEC),
    "nested": (lambda v: pair(v.cast("int"), pair(v, v.cast("double") + 12.0)), "struct<_1:int,_2:struct<_1:float,_2:double>>"),
    "nested_vector": (lambda v: pair(v.cast("int"), pair(v.cast("int") * 2, F.array(v.cast("double"), v.cast("double") + 1, v.cast("double") + 3))), f"struct<_1:int,_2:struct<_1:int,_2:{VEC}>>"),
    # generated kernels
    "plus3": (lambda v: v + 3, "int"),
    "outer_plus3": (lambda v: Outer(3).extern(v), "int"),
    "alloc_plus3": (lambda v: v + 3 + _at(F.array_repeat(F.lit(0), 5), 4) + _at(F.array_repeat(F.lit(0.0), 2), 1).cast("int"), "int"),
    "int_to_point": (lambda v: point(v + 1, v + 2, v + 3), POINT3),
    "point_shift": (lambda p: point(p["x"] + f32(1), p["y"] + f32(2), p["z"] + f32(3)), POINT3),
    "plus_captured": (lambda v: v + F.lit(1) + F.lit(2) + F.lit(3), "int"),
    "plus_points": (lambda v: f32(v) + f32(POINTS[0][0]) + f32(POINTS[1][1]) + f32(POINTS[2][2]), "float"),
    "plus4": (lambda v: v + 4, "int"),
    "mutated_point": (lambda p: _shifted(p, 4), POINT3),
    "pair_sum": (lambda t: t["_1"] + t["_2"], "int"),
    "point_sum": (lambda t: _xyz(t["_2"]), "float"),
    "first_plus3": (lambda t: t["_1"] + 3, "int"),
    "point_sum_plus3": (lambda t: _plus3(t["_2"]) + (t["_2"]["y"] + t["_2"]["z"]), "float"),
    "int_to_pair": (lambda v: pair(v + 1, f32(v) + f32(2)), "struct<_1:int,_2:float>"),
    "int_to_point_pair": (lambda v: pair(v + 1, point(F.lit(1), F.lit(2), F.lit(3))), f"struct<_1:int,_2:{POINT3}>"),
    "keyed_shift": (lambda t: pair(t["_1"], point(t["_2"] + f32(1), t["_2"] + f32(2), t["_2"] + f32(3))), f"struct<_1:int,_2:{POINT3}>"),
    "nearest_centre": (lambda p: nearest(F.array(*[p[c].cast("double") for c in "xyz"]), _lit2(UNIT_CENTRES))["id"], "int"),
    "sparse_first": (lambda s: pair(_at(s["indices"], 0), _at(s["values"], 0)), "struct<_1:int,_2:double>"),
    "doubled_range": (lambda v: F.transform(vseq(v), lambda i: i * 2.0), VEC),
    "sparse_tens": (lambda v: sparse(v, _filled(v, v * 10), _filled(v, (v * 20).cast("double"))), SPARSE),
    "lookup": (lambda v: _at(_ints(INTS), v % 5), "int"),
    "dense_diagonal": (lambda v: v.cast("double") + sum(ROWS[i][i] for i in range(5)), "double"),
    "sparse_diagonal": (lambda v: v.cast("double") + sum(ROWS[0][i] + i for i in range(5)), "double"),
    "computed_index": (lambda t: _at(t["_2"], t["_1"] - F.size(t["_2"]) - 4), "double"),
    "int_filled": (lambda v: pair(v, _filled(v, v.cast("double"))), f"struct<_1:int,_2:{VEC}>"),
    "pair_lookup": (lambda v: _at(_ints(INTS), v % 5) + _at(_ints(INTS[::-1]), v % 5), "int"),
    "vector_lookup": (lambda v: _at(_ints(INTS), v % 5) + _at(_at(_lit2(STEPPED), v % 5), 1).cast("int"), "int"),
    "five_times": (lambda v: v * 5, "int"),
    "first_only": (lambda v: F.transform(vseq(v), lambda i: F.when(i == 0, v).otherwise(0).cast("double")), VEC),
    "byte_products": (lambda t: F.aggregate(F.zip_with(t["_1"], t["_2"], lambda a, b: a.cast("int") * b.cast("int")), F.lit(0), lambda a, x: a + x), "int"),
    "rank_share": (lambda t: f32(F.try_divide(t["_1"], f32(t["_2"]))), "float"),
}


def kernel(name: str):
    """The function of a kernel, its result cast to the declared type."""
    f, ddl = KERNELS[name]
    return lambda *a: f(*a).cast(ddl)


def _as(bits: int):
    """The cast that results of each step take: to 32 bits, or to 64."""
    return f32 if bits == 32 else lambda c: F.lit(c).cast("double")


def normal_cdf(x: Column, bits: int = 64) -> Column:
    """The normal distribution function by its usual five-term polynomial."""
    num = _as(bits)
    #: The polynomial's coefficients.
    terms = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    k = num(num(1) / (num(1) + num(0.2316419) * F.abs(x)))
    powers = [k]
    for _ in terms[1:]:
        powers.append(num(powers[-1] * k))
    rest = powers[1] * num(terms[1])
    for p, c in list(zip(powers, terms))[2:]:
        rest = num(rest + p * num(c))
    poly = num(rest + k * num(terms[0]))
    density = num(F.exp((num(-0.5) * x * x).cast("double"))) * num(0.39894228040143270286)
    upper = num(num(1) - poly * density)
    return num(F.when(x < 0, num(1) - upper).otherwise(upper))


def option_price(spot: Column, strike: Column, rate: Column, vol: Column, time: Column, put: Column, log_ratio: bool = False, bits: int = 64) -> Column:
    """Price of a European option from 32-bit inputs, in steps of 64 or 32 bits; ``log_ratio`` takes ln(S / K) where the kernel as given takes S / K."""
    num = _as(bits)
    spot, strike, rate, vol, time = (num(c) for c in (spot, strike, rate, vol, time))
    ratio = num(spot / strike)
    term = num(F.ln(ratio)) if log_ratio else ratio
    spread = num(vol * num(F.sqrt(time)))
    d1 = num(((rate + vol * vol * num(0.5)) * time + term) / spread)
    d2 = num(d1 - spread)
    n1, n2 = normal_cdf(d1, bits), normal_cdf(d2, bits)
    future = num(strike * num(F.exp((-rate * time).cast("double"))))
    return num(F.when(put == 0, spot * n1 - future * n2).otherwise(future * (num(1) - n2) - spot * (num(1) - n1)))
