"""Reference-shaped inputs made of the test tables, for Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.functions.vectors import f32, to_sparse, utf8_bytes
from warpline.functions.kernels import pair, point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doubles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"))


def _line(spark: SparkSession, d: str, v) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), v.alias("v"))


def floats(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, f32(F.col("l_quantity")))


def points(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, _point())


def _point():
    return point(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))


def keyed_points(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, pair(F.col("l_linenumber"), _point()))


def float_doubles(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, pair(f32(F.col("l_discount")), F.col("l_extendedprice")))


def int_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, pair(F.col("l_linenumber"), F.col("l_quantity").cast("int")))


def keyed_floats(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, pair(F.col("l_linenumber"), f32(F.col("l_quantity"))))


def ints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))


def _vec(spark: SparkSession, d: str, v) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v.alias("v"))


def _e():
    return F.col("embedding").cast("array<double>")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d, _e())


def two_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d, pair(_e(), F.transform(_e(), lambda x: x * 2)))


def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d, to_sparse(_e()))


def keyed_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d, pair(F.col("label"), _e()))


def indexed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first member is an index past the vector's size and four: label + 68."""
    return _vec(spark, d, pair(F.col("label") + 68, _e()))


def byte_arrays(spark: SparkSession, d: str) -> DataFrame:
    """All UTF-8 bytes of every text."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), utf8_bytes(F.col("text")).alias("v"))


def byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), utf8_bytes(F.col("p_name")).alias("b"))
    return b.select("id", pair(F.col("b"), F.col("b")).alias("v"))


def rank_links(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d, pair(f32(F.col("l_quantity")), F.col("l_linenumber")))


_LINE = "SELECT l_orderkey AS id, l_linenumber AS n, {} FROM lineitem"
_XYZ = "l_quantity::FLOAT AS x, l_discount::FLOAT AS y, l_tax::FLOAT AS z"
_HEX = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: (('0x' || h)::INTEGER + 128) % 256 - 128)"

#: The same inputs as SQL; structs are separate columns.
SQL = {
    doubles: "SELECT event_id AS id, value AS v FROM events",
    floats: _LINE.format("l_quantity::FLOAT AS v"),
    points: _LINE.format(_XYZ),
    keyed_points: _LINE.format("l_linenumber AS k, " + _XYZ),
    float_doubles: _LINE.format("l_discount::FLOAT AS a, l_extendedprice AS b"),
    int_pairs: _LINE.format("l_linenumber AS a, trunc(l_quantity)::INTEGER AS b"),
    keyed_floats: _LINE.format("l_linenumber AS k, l_quantity::FLOAT AS v"),
    ints: "SELECT p_partkey AS id, p_size AS v FROM part",
    vectors: "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings",
    two_vectors: "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings",
    sparse_vectors: "SELECT vec_id AS id, len(embedding) AS size, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS i, list_filter(embedding::DOUBLE[], lambda x: x > 0) AS w FROM embeddings",
    keyed_vectors: "SELECT vec_id AS id, label AS k, embedding::DOUBLE[] AS v FROM embeddings",
    indexed_vectors: "SELECT vec_id AS id, label + 68 AS k, embedding::DOUBLE[] AS v FROM embeddings",
    byte_arrays: f"SELECT doc_id AS id, {_HEX.format('text')} AS v FROM documents",
    byte_pairs: f"SELECT p_partkey AS id, {_HEX.format('p_name')} AS v FROM part",
    rank_links: _LINE.format("l_quantity::FLOAT AS a, l_linenumber AS b"),
}
