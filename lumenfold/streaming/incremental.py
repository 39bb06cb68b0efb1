"""Incremental indexing: a stream of new image files into the catalog, one batch of what is new at a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import stored_index
from lumenfold.sources import images
from lumenfold.sources.catalog import Catalog
from lumenfold.sources.reports import MetricLog
from lumenfold.sources.tables import exists

IMAGE_STREAM = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def update(catalog: Catalog, new: DataFrame, methods: tuple[str, ...] = ("embedding",), *, index: str | None = None, n_cells: int = 16, log: MetricLog | None = None) -> None:
    """Extract features of new images (path, image) and write both tables: by key, so running twice changes nothing.  The
    stored index at `index` takes the features of the first method; where there is none yet, it is made of all.  `log`
    gets a row with the time it took and what was seen on the way: files, decoded images and their bytes."""
    whole, seen, began = F.col("image.height") > 0, Observation(), time.perf_counter()
    loaded = new.where(whole)
    # observed where the rows are read for the first table, which is once
    observed = new.observe(seen, F.count("*").alias("files"), F.count_if(whole).alias("decoded"), F.coalesce(F.sum(F.when(whole, F.octet_length("image.data"))), F.lit(0)).alias("bytes"))
    rows = observed.where(whole).select(F.col("path").alias("file_path"), S.file_name("path").alias("file_name"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.upper(S.extension("path")).alias("format"))
    catalog.add_images(rows)
    found = images.extract_features(loaded, methods)
    found = found.select(F.xxhash64("path").alias("image_id"), "feature_type", F.col("vector").alias("feature_vector"))
    catalog.cache_features(found)
    if index:
        as_vectors = lambda f: f.select(F.col("image_id").alias("vec_id"), F.col("feature_vector").alias("embedding"))
        known = catalog.features(methods[0])
        if not exists(new.sparkSession, f"{index}/cells"):
            if not known.isEmpty():
                stored_index.create(as_vectors(known), index, n_cells=n_cells)
        else:
            ids = loaded.select(F.xxhash64("path").alias("image_id")).distinct()
            stored_index.add(as_vectors(known.join(ids, "image_id", "left_semi")), index)
    if log:
        log.log("index_batch", time.perf_counter() - began, **seen.get)


def index_folder(spark: SparkSession, catalog: Catalog, folder: str, methods: tuple[str, ...] = ("embedding",), **how) -> None:
    """Index the files of a folder that the catalog does not have."""
    found = catalog.new_files(images.scan(spark, folder))
    update(catalog, images.load(spark, folder).join(found.select("path"), "path", "left_semi"), methods, **how)


def index_stream(spark: SparkSession, catalog: Catalog, folder: str, checkpoint: str, methods: tuple[str, ...] = ("embedding",), *, after: Callable[[DataFrame, int], None] | None = None, **how):
    """Index what has arrived since the last run (availableNow); returns the started query.  The checkpoint remembers
    files, and a batch that runs again after a failure upserts the same rows.  `log` gets a row for
    each batch, see update(); reports.StreamProgress adds how long its parts took."""
    source = spark.readStream.format("image").schema(IMAGE_STREAM).option("recursiveFileLookup", "true").load(folder)

    def one_batch(batch: DataFrame, number: int) -> None:
        update(catalog, batch.select(images.canonical("image.origin").alias("path"), "image"), methods, **how)
        if after:
            after(batch, number)

    return source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
