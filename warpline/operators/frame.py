"""Typed kernel maps over DataFrames.

A kernel is a Python function from Columns to a Column; it becomes part of the
plan, where Catalyst prunes, folds and compiles it. ``arrow`` kernels work on
NumPy or Arrow batches instead. Output types are declared and checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Kernel = Callable[..., Column]
ENGINES = ("native", "arrow")


def _struct(value: Column, metadata: Column | None) -> Column:
    meta = F.lit(None) if metadata is None else metadata
    return F.struct(value.alias("value"), meta.alias("metadata"))


class KernelFrame:
    """A DataFrame one column of which is the kernel's element.

    Other columns ride along unread. Everything else a DataFrame has is
    reachable as usual (``where``, ``count``, ...). ``engine`` chooses how
    kernels with two implementations run.
    """

    def __init__(self, df: DataFrame, value: str = "v", engine: str = "native") -> None:
        if engine not in ENGINES:
            raise ValueError(f"engine must be one of {ENGINES}")
        if value not in df.columns:
            raise ValueError(f"no column {value!r}")
        self.df, self.value, self.engine = df, value, engine

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("df", "value", "engine"):
            raise AttributeError(name)
        return getattr(self.df, name)

    def _with(self, df: DataFrame) -> KernelFrame:
        return type(self)(df, self.value, self.engine)

    def _replace(self, out: Column, returns: str | None) -> KernelFrame:
        return self._with(self.df.withColumn(self.value, out if returns is None else out.cast(returns)))

    def map(self, f: Kernel, returns: str | None = None, batch: Callable[[pa.Array], pa.Array] | None = None) -> KernelFrame:
        """One element to one. ``batch`` is the Arrow form, used by the arrow engine; it needs ``returns``."""
        if self.engine == "arrow" and batch is not None:
            if returns is None:
                raise ValueError("an Arrow kernel declares its type")
            return self._map_batches(batch, returns)
        return self._replace(f(F.col(self.value)), returns)

    def _map_batches(self, batch: Callable[[pa.Array], pa.Array], returns: str) -> KernelFrame:
        df, at = self.df, self.df.columns.index(self.value)
        kind = T._parse_datatype_string(returns)
        fields = [*df.schema.fields]
        fields[at] = T.StructField(self.value, kind)
        wanted = T.StructType(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cols = list(b.columns)
                cols[at] = batch(b.column(at))
                if len(cols[at]) != b.num_rows:
                    raise ValueError("a kernel gives one value for each element")
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        return self._with(df.mapInArrow(run, wanted))

    def map_async(self, kernel: Kernel, prologue: Callable[[Column], dict[str, Column]] | None = None, metadata: Kernel | None = None) -> KernelFrame:
        """One deferred value for each element, with metadata that may be null.

        ``prologue`` computes named columns first; the kernel gets the element
        and these. The element becomes ``struct<value, metadata>``.
        """
        v = F.col(self.value)
        made = prologue(v) if prologue else {}
        return self._replace(_struct(kernel(v, *made.values()), metadata(v) if metadata else None), None)

    def flat_map_async(self, *spawns: Kernel, metadata: Kernel | None = None) -> KernelFrame:
        """One element to one or more, a row for each spawn; no spawn is an error."""
        if not spawns:
            raise ValueError("at least one value must be spawned")
        v = F.col(self.value)
        out = F.array(*[_struct(k(v), metadata(v) if metadata else None) for k in spawns])
        return self._with(self.df.withColumn(self.value, F.explode(out)))

    def flat_map_array(self, f: Kernel) -> KernelFrame:
        """One element to a data-dependent number, at least one: an empty array raises when the row is read."""
        out = f(F.col(self.value))
        guarded = F.when(F.size(out) > 0, out).otherwise(F.raise_error("at least one value must be spawned"))
        return self._with(self.df.withColumn(self.value, F.explode(guarded)))

    def map_partitions_async(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """A whole partition as a stream of Arrow batches to any number of rows; empty partitions are fine."""
        return self.df.mapInArrow(f, schema)

    def map_partitions_accel(self, f: Callable[[Iterator[dict], Callable], Iterator], returns: str) -> DataFrame:
        """Element by element through an iterator that may call ``accel(kernel, n)``: ``kernel`` over ``0..n-1`` as one NumPy operation."""
        import numpy as np

        value, kind = self.value, T._parse_datatype_string(returns)
        arrow = T.StructType([T.StructField("value", kind)])
        from pyspark.sql.pandas.types import to_arrow_type

        out_type = to_arrow_type(kind)

        def accel(kernel: Callable, n: int):
            return kernel(np.arange(n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # one element at a time: a batch of long arrays as Python objects takes many times its Arrow memory
            items = (b.column(value).slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows))
            held: list = []
            for x in f(items, accel):
                held.append(x)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held, out_type)], names=["value"])
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(held, out_type)], names=["value"])

        return self.df.select(value).mapInArrow(run, arrow)


class PairFrame(KernelFrame):
    """A KernelFrame with a key column."""

    def __init__(self, df: DataFrame, key: str = "k", value: str = "v", engine: str = "native") -> None:
        if key not in df.columns:
            raise ValueError(f"no column {key!r}")
        self.key = key
        super().__init__(df, value, engine)

    def _with(self, df: DataFrame) -> PairFrame:
        return type(self)(df, self.key, self.value, self.engine)

    def map_pairs(self, f: Kernel, returns: str | None = None) -> KernelFrame:
        """Key and value to one new element."""
        out = f(F.col(self.key), F.col(self.value))
        return KernelFrame(self.df.withColumn(self.value, out if returns is None else out.cast(returns)), self.value, self.engine)

    def map_values(self, f: Kernel, returns: str | None = None) -> PairFrame:
        """Values alone; keys stay as they are."""
        return self._replace(f(F.col(self.value)), returns)


def cl(df: DataFrame, value: str = "v", engine: str = "native") -> KernelFrame:
    return KernelFrame(df, value, engine)


def pair_cl(df: DataFrame, key: str = "k", value: str = "v", engine: str = "native") -> PairFrame:
    return PairFrame(df, key, value, engine)


def index_map(n: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` over ``0..n-1``, as an array column."""
    from warpline.functions.vectors import vseq

    return F.transform(vseq(n), f)
