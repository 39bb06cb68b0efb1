"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when they are identical after lower-casing A-Z.  The index is built in three steps:

1. Every text gets a 64-bit key.  Chains: rows are combined by (key, text) - before the shuffle as well as
   after it, so a text with a billion copies travels once a task - which compares the bytes of colliding
   texts and leaves one entry for each distinct text.
2. Directory: entries are counted by the leading bits of their key.  Starting from one bucket, the directory
   doubles (looks at one more bit) wherever a bucket holds more than `capacity` entries, until all fit.
3. Entries are written to shared files, dealt by bucket range, so an owner task writes one range of keys.

Documents then look their key up: the directory - at most 2**max_depth slots, broadcast - names the bucket, and the
entry is found in that bucket by key.  A key whose chain has one text answers at once; rows whose key collides follow
the chain and are matched by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import forget, shared_dir, slices, small_side, stash

#: Columns that the operator adds.
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def bucket_of(key: Column, depth: Column | int) -> Column:
    """The leading `depth` bits of a key, as a number (0 for depth 0)."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(64) - depth).cast("int")))


def directory(keys: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(depth, prefix, n): the buckets that directory doubling ends with; each holds at most `capacity` keys
    unless it is as deep as `max_depth`.  At most 2**max_depth rows.

    A bucket of depth d is kept if it fits (or can't be split) and its parent did not fit.
    """
    finest = keys.groupBy(bucket_of(F.col("key"), max_depth).alias("fine")).agg(F.count("*").alias("n"))
    levels = finest.select(F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"), "fine", "n")
    levels = levels.groupBy("depth", F.call_function("shiftrightunsigned", F.col("fine"), (F.lit(max_depth) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("n").alias("n"))
    over = levels.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    split = levels.where("depth > 0").withColumn("parent", F.call_function("shiftrightunsigned", F.col("prefix"), F.lit(1))).join(over, ["depth", "parent"], "left_semi").drop("parent")
    return levels.where("depth = 0").unionByName(split).where((F.col("n") <= capacity) | (F.col("depth") == max_depth))


def build_index(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64, capacity: int = 1_000_000, max_depth: int = 16) -> DataFrame:
    """Write the index of docs under `folder` and return it: bucket (depth, prefix), key, chain (texts with that
    key), text_sha256, keep_id (largest id), group_size, and `text` only where chain > 1."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = rows.withColumn("key", key("norm"))
    entries = rows.groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = stash(entries.select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), folder, "entries")
    chains = entries.groupBy("key").agg(F.count("*").alias("chain"))
    collided = stash(chains.where("chain > 1").select("key"), folder, "collided")
    leaves = directory(chains.select("key"), capacity, max_depth)
    # every bucket covers a range of the finest prefixes: the directory proper, 2**max_depth slots at most
    low, high = (F.expr(f"shiftleft({p}, int({max_depth} - depth))") for p in ("prefix", "prefix + 1"))
    slots = stash(leaves.select("depth", "prefix", F.explode(F.sequence(low, high - 1)).alias("slot")), folder, "directory")
    placed = entries.withColumn("slot", bucket_of(F.col("key"), max_depth)).join(F.broadcast(slots), "slot")
    index = stash(placed.repartitionByRange(slices(docs.sparkSession), "slot", "key").drop("slot"), folder, "index")
    forget(docs.sparkSession, f"{folder}/entries")
    chained = rows.join(small_side(collided), "key", "left_semi")
    chained = chained.groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("text_sha256", F.sha2("norm", 256))
    stash(chained, folder, "chained")
    return index


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64, capacity: int = 1_000_000, max_depth: int = 16) -> DataFrame:
    """docs plus keep_id, group_size, kept and text_sha256 (see the module's text for the method).

    Null text counts as empty text.  Of equal texts the row with the largest id is kept; a null id is smaller
    than all others and is kept only in a group without any id.  Rows that repeat both id and text are one
    document listed again: they share the verdict, and group_size counts rows.  No rows, no result rows.
    Columns of docs keep their names; input columns named like a result column are replaced.
    """
    return _lookup(docs.drop(*RESULT), None, id_col, text_col, key, capacity, max_depth)


def verdicts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64, capacity: int = 1_000_000, max_depth: int = 16) -> DataFrame:
    """Only the id and keep_id, group_size, kept, text_sha256 of exact_dedup(); moves no text for the lookup."""
    return _lookup(docs.select(id_col, text_col), [id_col], id_col, text_col, key, capacity, max_depth)


def _lookup(docs: DataFrame, carried: list[str] | None, id_col: str, text_col: str, key, capacity: int, max_depth: int) -> DataFrame:
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    index = build_index(docs, folder, id_col=id_col, text_col=text_col, key=key, capacity=capacity, max_depth=max_depth)
    row = F.struct(*[F.col(f"`{c}`") for c in carried or docs.columns]).alias("row")
    keyed = docs.select(row, ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("key", key("norm"))
    slots = spark.read.parquet(f"{folder}/directory")
    keyed = keyed.withColumn("slot", bucket_of(F.col("key"), max_depth)).join(F.broadcast(slots), "slot").drop("slot")
    verdict, place = ["keep_id", "group_size", "text_sha256"], ["depth", "prefix", "key"]
    collided = spark.read.parquet(f"{folder}/collided")
    if collided.isEmpty():
        found = keyed.drop("norm").join(index.select(*place, *verdict), place)
    else:
        near = small_side(collided)
        single = keyed.drop("norm").join(near, "key", "left_anti").join(index.select(*place, *verdict), place)
        chained = keyed.join(near, "key", "left_semi").join(spark.read.parquet(f"{folder}/chained"), ["key", "norm"])
        found = single.select("row", *verdict).unionByName(chained.select("row", *verdict))
    kept = F.col(f"row.`{id_col}`").eqNullSafe(F.col("keep_id"))
    return found.select("row.*", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op1(spark, sf_dir: str) -> DataFrame:
    """op1_exact_dedup: one row per document."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
