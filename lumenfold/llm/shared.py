"""Shared-folder tables, batch helpers and other small things that the operators have in common."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one small side that may be broadcast (a checked bound, two longs a row: 32 MB).
BROADCAST_ROWS = 2_000_000


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share.  Where it is missing, a local folder is made for it on
    a local master, where all tasks run on this machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)  # a path without scheme belongs to the default file system
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the scratch() folder that is open."""
    return f"{_scratch.get() or shared_root(spark)}/lumenfold-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that operators write inside are deleted at the end.  Results are lazy and may read such
    tables, so write them (elsewhere) before the block ends."""
    folder = f"{shared_root(spark)}/lumenfold-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        forget(spark, folder)


def stash(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables of the shared folder once their readers are done."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps now instead of at its next periodic collection.  What refers to
    them goes in a first collection, so that the second finds them unused."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator adds on its way: drawn out until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def small_side(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of keys only if they have at most `rows` rows; beyond that Spark joins by shuffling."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def slices(spark: SparkSession) -> int:
    """The session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
