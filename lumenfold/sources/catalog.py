"""The image catalog: schemas, upserts by key, lookups, and what is new.

Tables are Parquet, partitioned by a hash of their key (features by type too), with Bloom filters on what is looked up.
An upsert rewrites the partitions of its rows and no others; a lookup reads one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.tables import exists, recover, replace_partitions, working_folder, written

IMAGES_DDL = "id long, file_path string, file_name string, file_size long, width int, height int, format string, created_date timestamp, modified_date timestamp, indexed_date timestamp, perceptual_hash string, is_blurry boolean, blur_score double"
FEATURES_DDL = "id long, image_id long, feature_type string, feature_vector array<float>, extraction_date timestamp"
DUPLICATES_DDL = "id long, representative_image_id long, duplicate_image_id long, similarity_score double, detection_date timestamp"
TABLES = {"images": IMAGES_DDL, "features": FEATURES_DDL, "duplicate_groups": DUPLICATES_DDL}
KEYS = {"images": ["file_path"], "features": ["image_id", "feature_type"], "duplicate_groups": ["representative_image_id", "duplicate_image_id"]}
#: What a table is partitioned by: `bucket`, the hash of the first key modulo BUCKETS, and more.
PARTITIONS = {"images": ["bucket"], "features": ["feature_type", "bucket"], "duplicate_groups": ["bucket"]}
BUCKETS = 64
#: Columns with a Bloom filter for each row group.
BLOOM = {"images": ["file_path", "id"], "features": ["image_id"], "duplicate_groups": ["representative_image_id"]}
#: Columns that say when a row was written: a row that differs in nothing else is not written again.
STAMPS = {"indexed_date", "extraction_date", "detection_date"}


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each key, that with the largest version.  An aggregate: old versions go before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Catalog:
    """Tables below a folder.  Writes replace partitions through rows that wait beside the table, see
    tables.replace_partitions(); what was interrupted is finished by whoever opens the table next.  One writer at a time;
    a reader may miss a partition for the moment in which it is replaced."""

    def __init__(self, spark: SparkSession, folder: str, *, keys: int = 10_000):
        """keys: different values that a row group's Bloom filter is made for, ten bits each; with more it admits more."""
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _stored(self, name: str) -> DataFrame:
        """The table with its bucket column."""
        recover(self.spark, self._path(name))
        schema = f"{TABLES[name]}, bucket int"
        if not exists(self.spark, self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        """rows with the table's columns and types; those that are missing are null."""
        fields = self.spark.createDataFrame([], TABLES[name]).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def _options(self, name: str) -> dict[str, str]:
        out = {}
        for c in BLOOM[name]:
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(self.keys)}
        return out

    def read(self, name: str) -> DataFrame:
        """The table; empty where nothing was written yet."""
        return self._stored(name).drop("bucket")

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the table."""
        rows = self._fitted(name, df).withColumn("bucket", bucket(F.col(KEYS[name][0])))
        replace_partitions(rows, self._path(name), PARTITIONS[name], whole=True, options=self._options(name))

    def upsert(self, name: str, rows: DataFrame) -> list[tuple]:
        """Insert rows, or replace those with the same key; of several new rows of a key one stays.  Rows that are there
        already, but for the time they were written at, change nothing.  Returns the partitions that were rewritten."""
        folder, by = working_folder(self.spark), PARTITIONS[name]
        new = self._fitted(name, rows).withColumn("bucket", bucket(F.col(KEYS[name][0])))
        new = written(latest(new, KEYS[name], [c for c in new.columns if c not in KEYS[name]]), f"{folder}/new")

        def reached(df: DataFrame) -> list[tuple]:
            """Partitions of df: BUCKETS for each type at most."""
            return sorted((tuple(r) for r in df.select(*by).distinct().collect()), key=str)

        def within(df: DataFrame, parts: list[tuple]) -> DataFrame:
            """Pruned by every partition column, then exact."""
            for k, c in enumerate(by):
                values = {p[k] for p in parts}
                df = df.where(F.col(c).isin([v for v in values if v is not None]) | (F.col(c).isNull() if None in values else F.lit(False)))
            exact = self.spark.createDataFrame(parts, ", ".join(f"of_{c} {df.schema[c].dataType.simpleString()}" for c in by))
            return df.join(F.broadcast(exact), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], "left_semi")

        parts = reached(new)
        if not parts:
            return []
        stored = self._stored(name)
        content = [c for c in stored.columns if c not in STAMPS]
        old = within(stored, parts).select(*[F.col(c).alias(f"was_{c}") for c in content])
        changed = written(new.join(old, [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in content], "left_anti"), f"{folder}/changed")
        parts = reached(changed)
        if parts:
            keys = changed.select(*[F.col(c).alias(f"is_{c}") for c in KEYS[name]])
            rest = within(stored, parts).join(keys, [F.col(c).eqNullSafe(F.col(f"is_{c}")) for c in KEYS[name]], "left_anti")
            replace_partitions(rest.unionByName(changed), self._path(name), by, options=self._options(name))
        return parts

    def backup(self, folder: str) -> None:
        """Copy all tables as they are now below `folder`/time stamp."""
        stamp = self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("s")).first()["s"]
        for name in TABLES:
            self.read(name).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{stamp}/{name}")

    def compact(self, *, backup: str | None = None) -> None:
        """Rewrite all tables to one file a partition, after a backup where one is asked for."""
        if backup:
            self.backup(backup)
        for name in TABLES:
            self.write(name, self.read(name))

    def clear(self, *names: str) -> None:
        """Empty the named tables (all where none is named), so that an index can be built anew."""
        for name in names or TABLES:
            self.write(name, self.spark.createDataFrame([], TABLES[name]))

    def add_images(self, rows: DataFrame) -> None:
        """rows need file_path; ids follow from it, so a replaced image keeps its features."""
        self.upsert("images", rows.withColumn("id", F.xxhash64("file_path")).withColumn("indexed_date", F.current_timestamp()))

    def cache_features(self, rows: DataFrame) -> None:
        self.upsert("features", rows.withColumn("id", F.xxhash64("image_id", "feature_type")).withColumn("extraction_date", F.current_timestamp()))

    def image(self, path: str) -> DataFrame:
        """The row of a file: one partition is read, and in it row groups whose Bloom filter admits the path."""
        return self._stored("images").where((F.col("bucket") == bucket(F.lit(path))) & (F.col("file_path") == path)).drop("bucket")

    def features(self, feature_type: str, image: int | None = None) -> DataFrame:
        """The features of a type, or those of one image, which lie in one partition."""
        rows = self._stored("features").where(F.col("feature_type") == feature_type)
        if image is not None:
            rows = rows.where((F.col("bucket") == bucket(F.lit(image).cast("long"))) & (F.col("image_id") == image))
        return rows.drop("bucket")

    def new_files(self, scanned: DataFrame, path_col: str = "path") -> DataFrame:
        """Scanned files that the catalog doesn't have."""
        known = self.read("images").select(F.col("file_path").alias(path_col))
        return scanned.join(known, path_col, "left_anti")

    def verify(self, dimension: int | None = None) -> DataFrame:
        """(feature_type, n, dims, ok): how many vectors there are and whether their sizes agree."""
        found = self.read("features").groupBy("feature_type").agg(F.count("*").alias("n"), F.count_distinct(F.size("feature_vector")).alias("dims"), F.max(F.size("feature_vector")).alias("dim"))
        good = (F.col("dims") == 1) if dimension is None else (F.col("dims") == 1) & (F.col("dim") == dimension)
        return found.select("feature_type", "n", "dims", good.alias("ok"))
