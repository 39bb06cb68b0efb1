"""Row numbers, predecessors and running sums of ordered sequences, without a whole sequence in one task.

A sequence (the frames of a video, the events of a user) may hold a third of all rows.  Its order is therefore cut into
buckets of the ordering column: rows are numbered within a bucket, and buckets - far fewer - are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def day_bucket(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts).cast("timestamp"))


def _beside(rows: DataFrame, per_bucket: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of their bucket; nulls meet nulls."""
    named = per_bucket.select(*[F.col(c).alias(f"__b_{c}") if c in on else F.col(c) for c in per_bucket.columns])
    both = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in on])
    return both.drop(*[f"__b_{c}" for c in on])


def with_index(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "frame_idx") -> DataFrame:
    """df plus its 0-based number within keys by order.  bucket must not decrease along the order, and (keys, order)
    should be unique: ties are numbered in any order."""
    rows = df.withColumn(BUCKET, bucket)
    counts = rows.groupBy(*keys, BUCKET).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    numbered = rows.withColumn("__i", F.row_number().over(within) - 1)
    out = _beside(numbered, offsets, [*keys, BUCKET])
    return out.select(*df.columns, (F.col("__i") + F.col("__before")).cast("long").alias(name))


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, name: str = "previous") -> DataFrame:
    """df plus the value of the row before, null for the first row of a sequence."""
    rows = df.withColumn(BUCKET, bucket)
    lasts = rows.groupBy(*keys, BUCKET).agg(F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__m"))
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    lasts = lasts.select(*keys, BUCKET, F.lag("__m.__v").over(across).alias("__carried"))
    within = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    own = rows.withColumn("__own", F.lag(value).over(within)).withColumn("__first", F.row_number().over(within) == 1)
    out = _beside(own, lasts, [*keys, BUCKET])
    return out.select(*df.columns, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__own")).alias(name))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """df plus the sum of value from the first row of the sequence up to this one."""
    rows = df.withColumn(BUCKET, bucket).withColumn("__v", value)
    sums = rows.groupBy(*keys, BUCKET).agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, BUCKET, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("__i", F.sum("__v").over(within))
    out = _beside(own, offsets, [*keys, BUCKET])
    return out.select(*df.columns, (F.col("__i") + F.col("__before")).alias(name))
