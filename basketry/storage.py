"""Intermediate tables in the cluster's shared folder.

A result that several later steps read is written once and read back. The written table cuts the
lineage, survives the loss of any executor, and gives the planner real sizes to choose joins by.
"""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


class _Scopes(threading.local):
    """Tables written so far, by scope; the first scope is the thread, of which streams have their own."""

    def __init__(self):
        self.stack: list[list[str]] = [[]]


_scopes = _Scopes()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    configured = spark.conf.get(_SETTING, None)
    if configured:
        return configured.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _scopes.stack[-1].append(path)
    return path


def save(df: DataFrame, label: str = "step") -> DataFrame:
    """Run ``df`` now, keep its rows as a Parquet table, return a scan of that table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hand_over(df: DataFrame, label: str = "step") -> DataFrame:
    """Like ``save``, but the table belongs to the scope around the present one, which may then end."""
    path = new_path(df.sparkSession, label)
    _scopes.stack[-1].remove(path)
    _scopes.stack[max(len(_scopes.stack) - 2, 0)].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what was written in the present scope, once no result needs it any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    written = _scopes.stack[-1]
    count = len(written)
    while written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


@contextmanager
def scope(spark: SparkSession):
    """What is written inside is deleted at the end, and nothing else.

    Results that are still to be read must leave the scope by an action (a write, a collect).
    """
    _scopes.stack.append([])
    try:
        yield
    finally:
        clear(spark)
        _scopes.stack.pop()
