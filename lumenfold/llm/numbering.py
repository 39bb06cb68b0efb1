"""Places of rows in the order of their group, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.shared import BROADCAST_ROWS, slices, stash

#: Bytes of texts among the keys that may be broadcast.
KEY_BYTES = 16 << 20


def numbered(df: DataFrame, groups: list[str], order: list[Column], folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of df with `before` and `total`: how many rows of their group come first, and how many there are; and the
    runs (groups, part, first, rows, before, total) they were counted by.  Column names `at` and `part` are taken.

    Rows are dealt out by ranges of (groups, order), so a group may span many tasks, and counted within each; a group
    has a run in every task at most, and runs are what is summed up.  Rows that tie are ordered as they come to lie;
    they are written once, so this holds from then on.  df itself must be cheap to read twice (ranges are sampled).
    """
    spark = df.sparkSession
    keys = [F.col(g).asc_nulls_first() for g in groups] + order
    laid = df.repartitionByRange(slices(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    laid = stash(laid, folder, name)
    part = F.shiftright("at", 33).alias("part")
    runs = laid.groupBy(*groups, part).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy(*(groups or [F.lit(0)]))
    runs = runs.withColumns({"before": F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("rows").over(own)})
    runs = stash(runs, folder, f"{name}_runs")
    known = runs.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"), "first", "before", "total")
    size = sum((F.coalesce(F.octet_length(F.col(g).cast("string")), F.lit(0)) for g in groups), F.lit(0))
    n, text = runs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    known = F.broadcast(known) if n <= BROADCAST_ROWS and text <= KEY_BYTES else known
    on = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups]
    placed = laid.withColumn("part", part).join(known, [*on, F.col("part") == F.col("of_part")])
    return placed.withColumn("before", F.col("at") - F.col("first") + F.col("before")).select(*df.columns, "before", "total"), runs
