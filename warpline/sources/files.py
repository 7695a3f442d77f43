"""Readers and writers: delimited text, Parquet tables, images, edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.operators.etl import parse_vector


def read_vectors(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """One vector of doubles for each text line."""
    return parse_vector(spark.read.text(path).withColumnRenamed("value", "line"), "line", sep=sep)


def read_rows(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Delimited text with a declared schema; nothing is inferred."""
    return spark.read.csv(path, schema=schema, sep=sep)


def read_edges(spark: SparkSession, path: str, first: str = "src", second: str = "dst", sep: str = "\t") -> DataFrame:
    """Two ids for each line, columns named by the caller: which end comes first is a choice of the file."""
    return spark.read.csv(path, schema=f"{first} long, {second} long", sep=sep)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet; ``partitions`` deals the rows anew first."""
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)


def write_lines(df: DataFrame, vec: str, path: str, files: int | None = None, sep: str = " ") -> None:
    """A text line of each vector; ``files`` merges the output into so many."""
    lines = df.select(F.array_join(F.transform(vec, lambda x: x.cast("string")), sep).alias("value"))
    (lines if files is None else lines.coalesce(files)).write.text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(origin, height, width, channels, data)`` by Spark's image source."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def last_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Rows of the last ``n`` part files of a table, by name."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(path + "/part-*"))
    names = sorted(str(s.getPath()) for s in found)[-n:]
    return spark.read.parquet(*names)
