"""Catalog tables: upserts that touch few partitions, replays, interruptions, lookups that read little."""

import os

import pytest
from pyspark.sql import functions as F

from lumenfold.sources import catalog as C
from lumenfold.sources import tables
from lumenfold.sources.catalog import Catalog


def files(folder):
    """Data files by partition, with their inodes."""
    return {(top.removeprefix(str(folder)), n): os.stat(f"{top}/{n}").st_ino for top, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def rows_read(df):
    """Rows that the scan of df handed up, after whole row groups were skipped."""
    plan = df._jdf.queryExecution()
    df._jdf.collect()
    node = plan.executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    while node.metrics().get("numOutputRows").isEmpty():
        node = node.inputPlan()
    return node.metrics().apply("numOutputRows").value()


@pytest.fixture
def catalog(spark, tmp_path):
    out = Catalog(spark, f"file://{tmp_path}/catalog")
    out.add_images(spark.range(2000).select(F.concat(F.lit("/pictures/"), F.sha2(F.col("id").cast("string"), 256)).alias("file_path"), F.lit(1).alias("width")))
    return out


def test_upsert_rewrites_one_partition(spark, tmp_path, catalog):
    top = tmp_path / "catalog/images"
    before = files(top)
    assert len(before) == C.BUCKETS and max(os.stat(f"{top}{d}/{n}").st_size for d, n in before) < 100_000
    one = spark.createDataFrame([("/pictures/new", 5)], "file_path string, width int")
    catalog.add_images(one)
    after = files(top)
    changed = {k[0] for k in before.keys() ^ after.keys()}
    assert len(changed) == 1 and len(after) == C.BUCKETS and catalog.read("images").count() == 2001
    # the same again changes nothing; another value replaces the row; files of former rows are gone
    catalog.add_images(one)
    assert files(top) == after
    catalog.add_images(one.withColumn("width", F.lit(6)))
    assert catalog.image("/pictures/new").first()["width"] == 6 and len(files(top)) == C.BUCKETS and catalog.read("images").count() == 2001
    assert catalog.upsert("images", one.limit(0)) == []


def test_upsert_of_odd_rows(spark, catalog):
    rows = spark.createDataFrame([(1, "a", [1.0]), (1, "a", [2.0]), (1, "b", [3.0]), (None, "b", [4.0]), (2, None, None)], "image_id long, feature_type string, feature_vector array<float>")
    catalog.cache_features(rows)
    catalog.cache_features(rows)
    assert catalog.read("features").count() == 4 and catalog.features("a").count() == 1 and catalog.features("b", 1).first()["feature_vector"] == [3.0]
    catalog.cache_features(spark.createDataFrame([(1, "a", [9.0])], rows.schema))
    assert catalog.features("a", 1).first()["feature_vector"] == [9.0] and catalog.read("features").count() == 4


def test_interrupted_upsert(spark, catalog, monkeypatch):
    """Rows that wait beside the table are put in place by the next reader."""
    with monkeypatch.context() as m:
        m.setattr(tables, "recover", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            catalog.add_images(spark.createDataFrame([("/pictures/late", 7)], "file_path string, width int"))
    assert catalog.image("/pictures/late").first()["width"] == 7 and catalog.read("images").count() == 2001


def test_lookups_read_little(spark, tmp_path, catalog):
    path = catalog.read("images").first()["file_path"]
    found = catalog.image(path)
    assert found.count() == 1 and rows_read(found) < 2000 / C.BUCKETS * 3
    assert found.select("_metadata.file_path").distinct().count() == 1
    # a path that isn't there, but within the range of its row group: the Bloom filter rules it out
    inside = [p for p in (f"/pictures/{'8' * 20}{k:044d}" for k in range(40))]
    none = [rows_read(catalog.image(p)) for p in inside]
    assert sum(n == 0 for n in none) >= 35, none
