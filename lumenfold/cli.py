"""Command line: search, index, duplicates, maintain."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import detect, lifecycle, stored_index, vectors
from lumenfold.sources import images, reports
from lumenfold.sources.catalog import Catalog
from lumenfold.sources.config import Settings
from lumenfold.sources.tables import forget
from lumenfold.streaming import incremental


def session() -> SparkSession:
    return SparkSession.builder.appName("lumenfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def search(spark: SparkSession, args, settings: Settings):
    """The k indexed images nearest to a query image: (rank, path, similarity)."""
    catalog = Catalog(spark, settings.catalog_dir)
    known = catalog.features(settings.index.methods[0]).select(F.col("image_id").alias("id"), F.col("feature_vector").alias("vector"))
    query = images.extract_features(images.load(spark, args.query), settings.index.methods[:1]).select(F.lit(-1).cast("long").alias("id"), "vector")
    if settings.search.index_type == "flat":
        found = vectors.knn_join(known, query, args.k, id_col="id", vector="vector")
    else:
        indexed, centres = stored_index.read(spark, f"{settings.catalog_dir}/index")
        found = vectors.search_cells(indexed, centres, query, args.k, probes=settings.search.probes, id_col="id", vector="vector")
    paths = catalog.read("images").select("id", F.col("file_path").alias("path"))
    out = found.join(paths, "id").select("rank", "path", "similarity").orderBy("rank")
    if args.output:
        reports.write_json(out, args.output)
    return out


def index(spark: SparkSession, args, settings: Settings):
    """Index the files of a folder that aren't yet; a stored index grows by their features only."""
    catalog = Catalog(spark, settings.catalog_dir)
    stored = None if settings.search.index_type == "flat" else f"{settings.catalog_dir}/index"
    incremental.index_folder(spark, catalog, args.folder, settings.index.methods, index=stored, n_cells=settings.search.cells)
    return catalog.read("images").agg(F.count("*").alias("indexed"))


def duplicates(spark: SparkSession, args, settings: Settings):
    """Groups of duplicates in a folder: (leader, n, bytes_saved, size_text), and a report where asked for."""
    scanned = images.scan(spark, args.folder, extensions=settings.index.extensions)
    pictures = images.load(spark, args.folder).join(scanned, "path").withColumn("id", F.xxhash64("path"))
    limits = settings.duplicates if args.threshold is None else type(settings.duplicates)(**{**vars(settings.duplicates), "hash_threshold": args.threshold})
    found = detect.staged(pictures, limits)
    lines = detect.report_lines(found, pictures.select("id", "size"))
    named = lines.join(pictures.select(F.col("id").alias("leader"), "path"), "leader").select(F.col("path").alias("leader"), "n", "bytes_saved", "size_text")
    if args.report:
        total = named.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes")).first()
        reports.html_report(named, total.asDict(), args.report)
    return named


def maintain(spark: SparkSession, args, settings: Settings):
    catalog = Catalog(spark, settings.catalog_dir)
    if args.task == "compact":
        catalog.compact(backup=f"{settings.catalog_dir}/backups")
    if args.task == "rebuild":
        catalog.clear("images", "features")
        forget(spark, f"{settings.catalog_dir}/index")
        index(spark, args, settings)
    if args.task == "clean":
        plan = lifecycle.expiry_plan(images.scan(spark, args.folder), args.as_of, args.days)
        return lifecycle.execute(plan, f"{settings.catalog_dir}/actions", dry_run=not args.yes).select("operation", "source", "outcome")
    return catalog.verify()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    top.add_argument("--config", default="config.yaml")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("search")
    p.add_argument("query")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("-o", "--output")
    p = sub.add_parser("index")
    p.add_argument("folder")
    p = sub.add_parser("duplicates")
    p.add_argument("folder")
    p.add_argument("-t", "--threshold", type=int)
    p.add_argument("-r", "--report")
    p = sub.add_parser("maintain")
    p.add_argument("task", choices=("verify", "compact", "clean", "rebuild"))
    p.add_argument("--folder")
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--as-of", default="1970-01-01")
    p.add_argument("--yes", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run = {"search": search, "index": index, "duplicates": duplicates, "maintain": maintain}[args.command]
    run(session(), args, Settings.load(args.config)).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
