"""Statistics of operations: means, deviations, totals and exact medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(df: DataFrame, key: str, value: str, *, width: float = 1.0) -> DataFrame:
    """(key, median_value): the exact median, the mean of the middle two for even counts.

    Values are counted by cells of `width`; only the cells that hold a middle value are looked into, so a key with a
    third of all rows isn't sorted in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("cell", F.floor(F.col("v") / width))
    cells = rows.groupBy("k", "cell").agg(F.count("*").alias("n"))
    order = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("k")))
    wanted = cells.withColumn("at", F.explode(F.array_distinct(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))))
    wanted = wanted.where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
    inside = rows.join(wanted.select("k", "cell", "before", "at"), ["k", "cell"])
    values = inside.groupBy("k", "at", "before", "v").agg(F.count("*").alias("c"))
    running = F.sum("c").over(Window.partitionBy("k", "at").orderBy("v"))
    hit = values.withColumn("upto", running + F.col("before")).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return hit.groupBy("k").agg(F.avg("v").alias("median_value")).withColumnRenamed("k", key)


def operation_stats(metrics: DataFrame, *, operation: str = "operation", duration: str = "duration", only: str | None = None, width: float = 1.0) -> DataFrame:
    """Mean, exact median, least, largest, population deviation, sum and count of durations by operation."""
    rows = metrics if only is None else metrics.where(F.col(operation) == only)
    rows = rows.where(F.col(operation).isNotNull())
    d = F.col(duration)
    sums = rows.groupBy(operation).agg(F.avg(d).alias("mean_value"), F.min(d).alias("min_value"), F.max(d).alias("max_value"), F.stddev_pop(d).alias("std_value"), F.sum(d).alias("total_value"), F.count(d).alias("n"))
    return sums.join(exact_median(rows, operation, duration, width=width), operation, "left")


def throughput(metrics: DataFrame, *, operation: str = "operation", duration: str = "duration") -> DataFrame:
    """Mean, deviation, sum and calls a second by operation."""
    d = F.col(duration)
    return metrics.groupBy(operation).agg(F.avg(d).alias("mean_value"), F.stddev_pop(d).alias("std_value"), F.sum(d).alias("total_value"), (F.count(d) / F.sum(d)).alias("per_second"))


def catalog_stats(df: DataFrame, size: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"))
