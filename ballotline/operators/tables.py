"""Written tables in the shared folder, and join hints by counted rows."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a temporary folder is made on a single machine; on a cluster, whose machines wouldn't share it, this raises.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ballotline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables written inside it at its end. What reads them must have been written elsewhere by then."""
    held = _scopes.__dict__.setdefault("open", [])
    held.append([])
    try:
        yield
    finally:
        for table in held.pop():
            table.drop()


class Written:
    """A DataFrame written as Parquet in the shared folder and read again: computed once, and safe from lost executors.

    It stays until ``drop``, or the end of the ``scratch`` that it was written in.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        if held := _scopes.__dict__.get("open"):
            held[-1].append(self)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, with a hint for joins: broadcast if it has at most ``most`` rows (counted), else merged by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")
