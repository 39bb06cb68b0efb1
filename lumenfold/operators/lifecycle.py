"""Action plans for files: delete to a trash folder, restore, empty, clear caches; and their execution.

Operators return plans; nothing is touched until execute() runs one in tasks, or apply() a short one on the driver; both
are dry by default.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.sources.tables import exists

PLAN = "operation string, source string, destination string, timestamp timestamp"


def delete_plan(files: DataFrame, trash: str, as_of: str, *, path: str = "path", to_trash: bool = True) -> DataFrame:
    """Move each file to the trash under its time stamp and name, or remove it."""
    when = F.lit(as_of).cast("timestamp")
    target = F.concat(F.lit(trash.rstrip("/") + "/"), S.stamp(when), F.lit("_"), S.file_name(path)) if to_trash else F.lit(None).cast("string")
    return files.select(F.lit("trash" if to_trash else "remove").alias("operation"), F.col(path).alias("source"), target.alias("destination"), when.alias("timestamp"))


def restore_plan(log: DataFrame, names: DataFrame, as_of: str) -> DataFrame:
    """Bring files back by name: the newest trash entry of each, to where it came from.  log is a table of PLAN rows."""
    kept = log.where("operation = 'trash'").withColumn("name", F.regexp_extract(S.file_name("destination"), r"^\d{8}_\d{6}_(.*)$", 1))
    newest = kept.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.max_by(F.struct("source", "destination"), F.struct("timestamp", "destination")).alias("r"))
    return newest.select(F.lit("restore").alias("operation"), F.col("r.destination").alias("source"), F.col("r.source").alias("destination"), F.lit(as_of).cast("timestamp").alias("timestamp"))


def expiry_plan(files: DataFrame, as_of: str, days: int = 30, *, path: str = "path", modified: str = "modified") -> DataFrame:
    """Remove files older than `days`: for the trash and for caches."""
    old = files.where(S.older_than(modified, as_of, days))
    return old.select(F.lit("remove").alias("operation"), F.col(path).alias("source"), F.lit(None).cast("string").alias("destination"), F.lit(as_of).cast("timestamp").alias("timestamp"))


def local(path: str) -> Path:
    return Path(path.removeprefix("file://").removeprefix("file:"))


def apply(plan: DataFrame, *, dry_run: bool = True) -> Iterator[tuple[str, str, str]]:
    """Yields (operation, source, outcome) row by row; files are only touched with dry_run=False.  Errors are outcomes."""
    for row in plan.toLocalIterator():
        outcome = "planned"
        if not dry_run:
            try:
                if row["operation"] == "remove":
                    os.remove(local(row["source"]))
                else:
                    local(row["destination"]).parent.mkdir(parents=True, exist_ok=True)
                    shutil.move(local(row["source"]), local(row["destination"]))
                outcome = "done"
            except OSError as error:
                outcome = f"error: {error}"
        yield row["operation"], row["source"], outcome


LOG = PLAN + ", outcome string, run string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs, abfs) and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), str(local(path)))


def act(operation: str, source: str, destination: str | None) -> str:
    """Do one row of a plan and say how it went.  What a task that was lost has done already is done."""
    try:
        at, path = file_system(source)
        there = at.get_file_info(path).type != fs.FileType.NotFound
        if operation == "remove":
            if there:
                at.delete_file(path)
            return "done"
        _, target = file_system(destination)
        taken = at.get_file_info(target).type != fs.FileType.NotFound
        if not there:
            return "done" if taken else "error: no such file"
        if taken:
            return "error: the destination is taken"
        at.create_dir(os.path.dirname(target), recursive=True)
        at.move(path, target)
        return "done"
    except (OSError, ValueError) as error:
        return f"error: {error}"


def execute(plan: DataFrame, log: str, *, dry_run: bool = True, tasks: int | None = None) -> DataFrame:
    """LOG rows of a plan that is carried out in tasks, wherever its files are.  Each row's outcome goes to the Parquet table
    `log`; rows that are done there already are left out, so a second run of a plan does nothing, and a lost task's rows
    may run again.  A destination that is taken is an error and nothing is overwritten.  Moves stay in one file system.
    """
    spark, run = plan.sparkSession, uuid.uuid4().hex
    keys = ["operation", "source", "timestamp"]
    rows = plan.select("operation", "source", "destination", "timestamp").dropDuplicates(keys)
    if exists(spark, log):
        done = spark.read.schema(LOG).parquet(log).where("outcome = 'done'").select(*[F.col(k).alias(f"of_{k}") for k in keys])
        rows = rows.join(done, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], "left_anti")
    if dry_run:
        return rows.withColumns({"outcome": F.lit("planned"), "run": F.lit(run)})

    outcome = F.udf(act, "string", useArrow=False).asNondeterministic()
    # files are moved while the log is written, once; what is returned reads the log
    dealt = rows.repartition(tasks or spark.sparkContext.defaultParallelism * 4, "source")
    found = dealt.withColumn("outcome", outcome("operation", "source", "destination")).withColumn("run", F.lit(run))
    found.write.mode("append").parquet(log)
    return spark.read.schema(LOG).parquet(log).where(F.col("run") == run)


def is_allowed_folder(path: str, *, allow_system: bool = False) -> bool:
    """Whether a folder exists, can be read, and is no system folder."""
    full = os.path.realpath(local(path))
    denied = ("/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/sbin", "/sys", "/usr", "/var")
    system = any(full == d or full.startswith(d + "/") for d in denied)
    return os.path.isdir(full) and os.access(full, os.R_OK) and (allow_system or not system)
