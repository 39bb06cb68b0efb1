"""Working tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.  Where that is unset, a local folder is made for it on a local master,
    where all tasks run on this machine; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete working tables that nothing reads any more."""
    for path in paths:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def replace_partitions(df: DataFrame, path: str, by: list[str], *, whole: bool = False, options: dict[str, str] | None = None) -> None:
    """Replace those partitions of the table at `path` that df has rows of (or, with `whole`, the table).  Rows are written
    beside the table first: what is interrupted after that is finished by recover(), before that nothing has changed.
    df may read the table."""
    pending = f"{path}_pending"
    df.write.mode("overwrite").parquet(f"{pending}/rows")
    how = df.sparkSession.createDataFrame([(",".join(by), whole, list((options or {}).items()))], "by string, whole boolean, options array<struct<k: string, v: string>>")
    how.coalesce(1).write.mode("overwrite").json(f"{pending}/how")
    recover(df.sparkSession, path)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a replacement of partitions that was interrupted; call it before the table is read or written."""
    pending = f"{path}_pending"
    if not exists(spark, f"{pending}/how/_SUCCESS"):
        return
    how = spark.read.schema("by string, whole boolean, options array<struct<k: string, v: string>>").json(f"{pending}/how").first()
    by, rows = how["by"].split(","), spark.read.parquet(f"{pending}/rows")
    out = rows.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy(*by)
    out.option("partitionOverwriteMode", "static" if how["whole"] else "dynamic").options(**{o["k"]: o["v"] for o in how["options"]}).parquet(path)
    forget(spark, f"{pending}/how", pending)
