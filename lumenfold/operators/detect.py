"""Duplicate detectors: the staged cascade (hash, embedding, structure), and detectors by size bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.functions import scalars as S
from lumenfold.operators import cluster, groups, hamming, vectors
from lumenfold.sources import images as I
from lumenfold.sources.config import DuplicateSettings
from lumenfold.sources.tables import working_folder, written

#: How the detectors by size shrink images before hashing: more pixels than that, to this longest side, by method.
DETECTORS = {"fast": (1_000_000, 1000, "area", False), "performance": (500_000, 800, "area", True), "memory": (200_000, 500, "nearest", True)}


def hash_groups(hashed: DataFrame, threshold: int, *, closed_exact: bool = True) -> DataFrame:
    """(leader, member) by perceptual hashes: hashed has id, phash and dhash.

    Equal phashes form groups first, and - with closed_exact - take no part in what follows; the others cluster by
    either hash, through classes of equal hashes, so copies by one hash keep all links of both.  Groups that share a
    leader are one.
    """
    exact = groups.edges(hashed, F.col("phash"), "id").select(F.col("representative").alias("leader"), F.col("duplicate").alias("member"))
    rest = hashed
    if closed_exact:
        crowd = groups.exact_groups(hashed, F.col("phash"), "id").select(F.col("key").alias("phash"))
        rest = hashed.join(crowd, "phash", "left_anti")
    near = cluster.leaders_of_classes(*hamming.class_links(rest, threshold))
    return exact.union(near).distinct()


def with_group(found: DataFrame) -> DataFrame:
    """(group_id, id) of all members, leaders included."""
    return found.select(F.col("leader").alias("group_id"), F.col("member").alias("id")).union(found.select("leader", "leader")).distinct()


def embedding_groups(candidates: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """(leader, member) by cosine within candidate groups; features has id and vector.

    Equal vectors of a group are one class: classes are compared, and their members never paired, so a group of equal
    pictures costs a row for each.  Zero vectors have cosine 0 with their like, too."""
    rows = written(candidates.join(features, "id").where("vector is not null").select("group_id", "id", "vector"), f"{working_folder(features.sparkSession)}/vectors")
    name = lambda g, i: F.concat_ws(":", F.col(g).cast("string"), F.col(i).cast("string"))
    classes = rows.groupBy("group_id", "vector").agg(F.min("id").alias("rep"))
    alone = ~F.exists("vector", lambda x: x != 0) if threshold > 0 else F.lit(False)
    of = classes.select(F.col("group_id").alias("g"), F.col("vector").alias("v"), "rep")
    members = rows.join(of, (F.col("group_id") == F.col("g")) & (F.col("vector") == F.col("v")))
    nodes = members.select("id", F.when(alone, F.concat_ws(":", name("group_id", "rep"), F.col("id").cast("string"))).otherwise(name("group_id", "rep")).alias("c"))
    several = classes.groupBy(F.col("group_id").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g")
    compared = classes.join(several, F.col("group_id") == F.col("g"), "left_semi")
    pairs = vectors.similar_pairs(compared, threshold, id_col="rep", vector="vector", group="group_id", with_group=True)
    return cluster.leaders_of_classes(nodes, pairs.select(name("group_id", "i").alias("c"), name("group_id", "j").alias("d")))


def structure_groups(found: DataFrame, pictures: DataFrame, threshold: float) -> DataFrame:
    """(leader, member, score): members whose structural similarity with their leader reaches the threshold.
    Only leaders are compared with members; what is turned down is not clustered again."""
    first = pictures.select(F.col("id").alias("leader"), F.col("image").alias("__a"))
    second = pictures.select(F.col("id").alias("member"), F.col("image").alias("__b"))
    score = I.pair_column(K.ssim, "double")
    rows = found.join(second, "member").join(first, "leader").withColumn("score", score(F.col("__a"), F.col("__b")))
    return rows.where(F.col("score") >= threshold).select("leader", "member", "score")


def staged(pictures: DataFrame, settings: DuplicateSettings | None = None) -> DataFrame:
    """(leader, member) after the stages that the settings enable; pictures has id and image.
    Each stage works on the groups that the one before has left."""
    settings, folder = settings or DuplicateSettings(), working_folder(pictures.sparkSession)
    found = None
    if settings.enable_hash:
        # read several times: pixels are looked at once
        found = written(hash_groups(written(I.hashes(pictures).select("id", "phash", "dhash"), f"{folder}/hashes"), settings.hash_threshold), f"{folder}/hash_groups")
    if settings.enable_embedding:
        candidates = with_group(found) if found is not None else pictures.select(F.lit(0).cast("long").alias("group_id"), "id")
        chosen = pictures.join(candidates.select("id").distinct(), "id", "left_semi")
        features = I.extract_features(chosen.select(F.col("id").cast("string").alias("path"), "image")).select(F.col("path").cast("long").alias("id"), "vector")
        found = embedding_groups(candidates, features, settings.embedding_threshold)
    if found is None:
        raise ValueError("enable the hash or the embedding stage: structure alone has no candidates")
    if settings.enable_ssim:
        found = structure_groups(found, pictures, settings.ssim_threshold).select("leader", "member")
    return found


def by_size(files: DataFrame, threshold: int = 5, detector: str = "memory") -> DataFrame:
    """(leader, member) within KiB buckets of file size by phash; files has id, size and image.
    Buckets of one file are dropped before anything is decoded."""
    max_pixels, longest, method, skip_empty = DETECTORS[detector]
    crowded = groups.size_blocks(files, "size", skip_empty=skip_empty)
    hashed = I.hashes(crowded.select("id", "kb_bucket", "image"), max_pixels=max_pixels, longest=longest, method=method).select("id", "kb_bucket", "phash")
    hashed = written(hashed, f"{working_folder(files.sparkSession)}/hashes")  # read several times: pixels are looked at once
    same = hashed.groupBy("kb_bucket", "phash").agg(F.min("id").alias("i"))
    copies = hashed.join(same, ["kb_bucket", "phash"]).where("id <> i").select("i", F.col("id").alias("j"))
    near = hamming.near_pairs(hashed, threshold, hash_col="phash", bucket="kb_bucket").select("i", "j")
    # a copy is as near to others as its representative, which comes first: it joins the same leader
    firsts = cluster.leaders(near)
    moved = copies.join(firsts.select(F.col("member").alias("i"), "leader"), "i", "left").select(F.coalesce("leader", "i").alias("leader"), F.col("j").alias("member"))
    return firsts.union(moved).distinct()


def report_lines(found: DataFrame, files: DataFrame) -> DataFrame:
    """(leader, n, bytes_saved, size_text) for each group; files has id and size."""
    rows = found.join(files.select(F.col("id").alias("member"), "size"), "member")
    return rows.groupBy("leader").agg((F.count("*") + 1).alias("n"), F.sum("size").alias("bytes_saved")).withColumn("size_text", S.human_size("bytes_saved"))
