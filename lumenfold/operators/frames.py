"""Frame sequences: key frames, scene segments, middle frames, pooled embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import kernels
from lumenfold.functions import scalars as S
from lumenfold.operators import ordered
from lumenfold.sources.images import pair_column


def uniform_keyframes(frames: DataFrame, *, every: int = 30, index: str = "frame_idx") -> DataFrame:
    """Frames whose number is a multiple of `every`."""
    return frames.where(F.col(index) % every == 0)


def change_keyframes(frames: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, differs) -> DataFrame:
    """The first frame of each sequence, and frames for which differs(previous, current) holds."""
    rows = ordered.with_previous(frames, keys, order, value, bucket, "__previous")
    return rows.where(F.col("__previous").isNull() | differs(F.col("__previous"), F.col(value))).drop("__previous")


def scene_keyframes(frames: DataFrame, keys: list[str], order: list[str], bucket: Column, *, histogram: str = "hist", threshold: float = 0.7) -> DataFrame:
    """Frames whose histogram correlates less than `threshold` with that of the frame before."""
    return change_keyframes(frames, keys, order, histogram, bucket, lambda p, c: S.histogram_correlation(p, c) < threshold)


def motion_keyframes(frames: DataFrame, keys: list[str], order: list[str], bucket: Column, *, image: str = "image", threshold: float = 5.0, block: int = 16, reach: int = 7) -> DataFrame:
    """The first frame of each sequence, and frames that moved more than `threshold` pixels against the one before;
    plus motion, null for first frames."""
    moved = ordered.with_previous(frames, keys, order, image, bucket, "__before")
    motion = pair_column(lambda a, b: kernels.motion(a, b, block=block, reach=reach), "double")
    scored = moved.withColumn("motion", motion(F.col("__before"), F.col(image)))
    return scored.where(F.col("__before").isNull() | (F.col("motion") > threshold)).drop("__before")


def extract(frames: DataFrame, method: str, keys: list[str], order: list[str], bucket: Column, **how) -> DataFrame:
    """Key frames by the method's name: uniform (every n-th frame), scene (histograms) or motion.  Frames that have a
    column of numbers already, as those of video files, keep them."""
    if method == "uniform":
        numbered = how.get("index", "frame_idx") in frames.columns
        return uniform_keyframes(frames if numbered else ordered.with_index(frames, keys, order, bucket), **how)
    if method == "scene":
        return scene_keyframes(frames, keys, order, bucket, **how)
    if method == "motion":
        return motion_keyframes(frames, keys, order, bucket, **how)
    raise ValueError(f"method must be uniform, scene or motion, not {method!r}")


def scene_segments(frames: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column, *, cut, index: str = "frame_idx") -> DataFrame:
    """(keys, scene_no, start_frame, end_frame): half-open runs of frames; cut(previous, current) begins a new one."""
    numbered = ordered.with_index(frames, keys, order, bucket, index)
    rows = ordered.with_previous(numbered, keys, order, value, bucket, "__previous")
    is_cut = F.coalesce(cut(F.col("__previous"), F.col(value)), F.lit(False)).cast("long")
    rows = ordered.with_running_sum(rows, keys, order, is_cut, bucket, "scene_no")
    return rows.groupBy(*keys, "scene_no").agg(F.min(index).alias("start_frame"), (F.max(index) + 1).alias("end_frame"))


def middle_frames(frames: DataFrame, keys: list[str], *, index: str = "frame_idx") -> DataFrame:
    """Each sequence's frame number count div 2."""
    middles = frames.groupBy(*keys).agg(F.floor(F.count("*") / 2).cast("long").alias(index))
    return frames.join(middles, [*keys, index])


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, dim, mean_value): the mean of each dimension; not normalised again, no rows where there is no vector."""
    at = df.select(*keys, F.posexplode(S.doubles(vector)).alias("dim", "x"))
    return at.groupBy(*keys, "dim").agg(F.avg("x").alias("mean_value"))


def pooled_vectors(df: DataFrame, keys: list[str], vector: str, name: str = "vector") -> DataFrame:
    """mean_pool() with one array for each key."""
    pooled = mean_pool(df, keys, vector)
    return pooled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "mean_value"))).alias("__p")).select(*keys, F.transform("__p", lambda s: s["mean_value"]).alias(name))


def descriptor_stats(df: DataFrame, keys: list[str], descriptors: str) -> DataFrame:
    """(keys, dim, mean_value, std_value): mean and population deviation over the descriptors of a key."""
    at = df.select(*keys, F.posexplode(S.doubles(descriptors)).alias("dim", "x"))
    return at.groupBy(*keys, "dim").agg(F.avg("x").alias("mean_value"), F.stddev_pop("x").alias("std_value"))
