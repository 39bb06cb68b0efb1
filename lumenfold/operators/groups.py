"""Duplicate groups: exact keys, representatives, edges and arrays, best copies, savings, clean-up plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S


def exact_groups(df: DataFrame, key: Column, id_col: str, *, smallest: int = 2) -> DataFrame:
    """(key, n, representative): keys of at least `smallest` rows and their smallest id; null keys are left out."""
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("representative")).where(F.col("n") >= smallest)


def members(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """The rows of exact groups, plus representative and n."""
    groups = exact_groups(df, key, id_col).withColumnRenamed("key", "__key")
    return df.withColumn("__key", key).join(groups, "__key").drop("__key")


def edges(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(representative, duplicate) for every member that does not represent its group."""
    return members(df, key, id_col).where(F.col(id_col) != F.col("representative")).select("representative", F.col(id_col).alias("duplicate"))


def arrays(dup_edges: DataFrame, *, chunk: int = 1000) -> DataFrame:
    """(representative, chunk, duplicates): members as sorted arrays of about `chunk`; a group of any size is spread
    over as many rows as it needs, by id modulo."""
    sizes = dup_edges.groupBy("representative").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    rows = dup_edges.join(sizes, "representative").withColumn("chunk", F.pmod(F.col("duplicate"), F.col("chunks")))
    return rows.groupBy("representative", "chunk").agg(F.array_sort(F.collect_list("duplicate")).alias("duplicates"))


def space_savings(df: DataFrame, group: str, representative: str, id_col: str, size: str) -> DataFrame:
    """One row: groups, duplicates, and the bytes of all members that don't represent their group."""
    extra = F.col(id_col) != F.col(representative)
    per_group = df.groupBy(group).agg(F.count(F.when(extra, 1)).alias("d"), F.sum(F.when(extra, F.col(size))).alias("b"))
    return per_group.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes_saved"))


def group_summary(df: DataFrame, group: str, size: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(size).alias("total_bytes"), F.max(size).alias("largest"))


def best_of_group(df: DataFrame, group: str, score: Column, id_col: str) -> DataFrame:
    """(group, best, score, n): the member with the highest score, the smallest id among equals.  An aggregate,
    so large groups are combined before the shuffle.  Ids must be numbers."""
    best = F.max(F.struct(score.alias("s"), (-F.col(id_col)).alias("i")))
    return df.groupBy(group).agg(best.alias("b"), F.count("*").alias("n")).select(group, (-F.col("b.i")).alias("best"), F.col("b.s").alias("score"), "n")


def clean_plan(df: DataFrame, group: str, score: Column, id_col: str) -> DataFrame:
    """df plus best and action (keep or delete): what cleaning would do; nothing is touched."""
    best = best_of_group(df, group, score, id_col).select(group, "best")
    return df.join(best, group).withColumn("action", F.when(F.col(id_col) == F.col("best"), "keep").otherwise("delete"))


def clean_summary(plan: DataFrame, group: str, size: str) -> DataFrame:
    """One row: groups with something to delete, files to delete, bytes they would free."""
    gone = plan.where(F.col("action") == "delete")
    per_group = gone.groupBy(group).agg(F.count("*").alias("d"), F.sum(size).alias("b"))
    return per_group.agg(F.count("*").alias("processed_groups"), F.coalesce(F.sum("d"), F.lit(0)).alias("files_deleted"), F.coalesce(F.sum("b"), F.lit(0)).alias("space_saved"))


def after_delete(dup_edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(representative, duplicate) of what is left: deleted members go, the smallest survivor takes a deleted
    representative's place, and groups of one disappear.  deleted has the column id."""
    both = dup_edges.select("representative", F.col("duplicate").alias("id")).union(dup_edges.select("representative", F.col("representative").alias("id"))).distinct()
    left = both.join(deleted.select("id").distinct(), "id", "left_anti")
    first = left.groupBy("representative").agg(F.min(F.struct((F.col("id") != F.col("representative")).alias("moved"), "id")).alias("f"))
    left = left.join(first, "representative").select(F.col("f.id").alias("new"), "id")
    return left.where("id <> new").select(F.col("new").alias("representative"), F.col("id").alias("duplicate"))


def size_blocks(df: DataFrame, size: str, *, skip_empty: bool = True) -> DataFrame:
    """Rows of size buckets (whole KiB) that hold two or more; empty files can be kept out."""
    rows = df.where(F.col(size) > 0) if skip_empty else df
    rows = rows.withColumn("kb_bucket", S.kb_bucket(size))
    crowded = rows.groupBy("kb_bucket").agg(F.count("*").alias("bucket_n")).where("bucket_n > 1")
    return rows.join(crowded, "kb_bucket")
