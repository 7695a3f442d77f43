"""Dataset preparation: rows to vectors, graph ids, image text, copies and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.functions.vectors import vdownsample
from warpline.operators.keyed import even_copies, replicate, zip_with_index

__all__ = ["crop_rgb", "doc_ranks", "downsample", "even_copies", "fake_labels", "filter_edges", "fold_id", "normalize_edges", "parse_vector", "replicate", "rows_to_vectors", "smallest_image"]


def rows_to_vectors(df: DataFrame, id_: str, vec: str = "v") -> DataFrame:
    """Every column but the id as one array of doubles, in order."""
    return df.select(F.array(*[F.col(c).cast("double") for c in df.columns if c != id_]).alias(vec))


def parse_vector(df: DataFrame, line: str, vec: str = "v", sep: str = " ") -> DataFrame:
    """A text line of numbers as an array of doubles; runs of separators count once."""
    parts = F.filter(F.split(line, f"[{sep}]+"), lambda s: s != "")
    return df.withColumn(vec, F.transform(parts, lambda s: s.cast("double"))).drop(line)


def fold_id(c) -> F.Column:
    """``abs(int(long))``: the low 32 bits as a signed number, without sign. The least int stays itself."""
    low = F.pmod(c.cast("long") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.when(low == -(1 << 31), low).otherwise(F.abs(low))


def normalize_edges(edges: DataFrame, fold: bool = True) -> tuple[DataFrame, DataFrame]:
    """``edges(src, dst)`` with dense node ids in order of the old ones, and ``nodes(node, idx)``.

    The map from old to new ids is a table; both ends join it.
    """
    e = edges.select(fold_id(F.col("src")).alias("src"), fold_id(F.col("dst")).alias("dst")) if fold else edges.select("src", "dst")
    nodes = zip_with_index(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), ["node"])
    s = nodes.select(F.col("node").alias("src"), F.col("idx").alias("_s"))
    d = nodes.select(F.col("node").alias("dst"), F.col("idx").alias("_d"))
    return e.join(s, "src").join(d, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst")), nodes


def doc_ranks(nodes: DataFrame, id_: str, seed: int = 1) -> DataFrame:
    """A rank in [0, 100) and a link count in [60, 100) for each node, fixed by the id and seed."""
    unit = lambda k: F.pmod(F.xxhash64(F.col(id_), F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    return nodes.select(F.col(id_).alias("id"), (unit(0) * 100).alias("rank"), (60 + F.floor(unit(1) * 40)).cast("int").alias("links"))


def filter_edges(edges: DataFrame, n_nodes: int, share: float) -> DataFrame:
    """Edges both ends of which are below floor(n_nodes * share)."""
    limit = int(n_nodes * share)
    return edges.where((F.col("src") < limit) & (F.col("dst") < limit))


def downsample(df: DataFrame, vec: str, k: int) -> DataFrame:
    return df.withColumn(vec, vdownsample(F.col(vec), k))


def fake_labels(df: DataFrame, id_: str, n: int, seed: int = 1) -> DataFrame:
    """A label vector of ``n`` numbers in [0, 1) for each id, fixed by the id and seed."""
    draw = lambda i: F.pmod(F.xxhash64(F.col(id_), F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)
    return df.select(id_, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw).alias("label"))


def smallest_image(images: DataFrame) -> DataFrame:
    """``(height, width)``: the least of each over ``images(height, width)``."""
    return images.agg(F.min("height").alias("height"), F.min("width").alias("width"))


def crop_rgb(images: DataFrame, height: int, width: int) -> DataFrame:
    """``images(id, height, width, channels, data)`` cut to the top left, as ints R G B by rows.

    ``data`` has the layout of Spark's image source: rows from the top, B G R.
    """
    at = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.transform(F.array(F.lit(2), F.lit(1), F.lit(0)), lambda k: (r * F.col("width") + c) * F.col("channels") + k)))))
    rows = images.where((F.col("height") >= height) & (F.col("width") >= width))
    # the lambda's parameter is computed once for each image; a column that it names would be for each byte
    byte = lambda b, i: F.when(i >= 0, F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("int"))
    cut = F.transform(F.array("data"), lambda b: F.transform(at, lambda i: byte(b, i)))
    return rows.select("id", F.get(cut, F.lit(0)).alias("v"))
