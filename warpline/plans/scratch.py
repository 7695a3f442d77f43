"""Tables in the folder that driver and executors share.

Iterative plans cut their lineage by writing a table there and reading it
again. Written files outlive the executors that wrote them, so the loss of an
executor never costs more than the tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Rows of a written table of few numbers that the driver may get for a broadcast.
BROADCAST_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one local process (as in tests), a
    temporary folder is made and removed at exit. A cluster without the setting
    is an error: a machine-local folder would not be seen by the executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="warpline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


class Scratch:
    """Tables of one operator call, under one folder of their own."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``save`` that nothing will read again."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def bounded(table: DataFrame) -> DataFrame:
    """A written table as a side of a join; beyond ``BROADCAST_ROWS`` rows it is merged and never broadcast.

    By itself Spark goes by the bytes on disk, of which a row may have far
    fewer than in the driver's memory.
    """
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, found by exact spelling.

    Columns go by position, so further columns whose names differ only in
    case, or repeat, cause no ambiguity. The first of equal names counts.
    """
    at = {n: i for i, n in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at[n]}").alias(n) for n in names])
