"""Kernels over streams: the same columns, read and written incrementally."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema that it has now."""
    schema = spark.read.parquet(path).schema
    # a stream's source is a folder or a pattern, also where the table is one file
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Everything the stream has now, appended once to a table under ``folder`` that all executors share."""
    spark = stream.sparkSession
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
