"""Image files end to end: scan, decode, catalog, streaming index, detection, configuration."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold import cli
from lumenfold.functions import kernels as K
from lumenfold.operators import detect, frames, vectors
from lumenfold.plans import image_queries
from lumenfold.sources import images, reports
from lumenfold.sources.catalog import Catalog
from lumenfold.sources.config import PROFILES, DuplicateSettings, SearchSettings, Settings
from lumenfold.streaming import incremental


def png(path, pixels):
    h, w = pixels.shape[:2]
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(9)
    a, b = (np.clip(K.gaussian(rng.integers(0, 256, (96, 96, 3)), 2) * 3 - 250, 0, 255).astype(np.uint8) for _ in range(2))
    png(top / "original.png", a)
    png(top / "duplicate.png", a)
    png(top / "near.PNG", np.clip(1.05 * a.astype(float) + 4, 0, 255).astype(np.uint8))
    png(top / "different.png", b)
    (top / "broken.png").write_bytes(b"no image")
    (top / "notes.txt").write_text("x")
    return top


def test_scan_and_metadata(spark, folder):
    scanned, loaded = images.scan(spark, str(folder)), images.load(spark, str(folder))
    assert scanned.count() == 5 and loaded.count() == 4
    assert images.unreadable(scanned, loaded).first()["path"].endswith("broken.png")
    rows = {r["file_name"]: r for r in images.metadata(scanned, loaded).collect()}
    assert rows["near.PNG"]["format"] == "PNG" and rows["original.png"]["width"] == 96


def test_staged_detection(spark, folder):
    pictures = images.load(spark, str(folder)).withColumn("id", F.xxhash64("path"))
    names = {r["id"]: r["path"].rsplit("/", 1)[1] for r in pictures.select("id", "path").collect()}
    found = detect.staged(pictures, DuplicateSettings())
    groups = [{names[r["leader"]], names[r["member"]]} for r in found.collect()]
    assert {"original.png", "duplicate.png"} in groups and not any("different.png" in g for g in groups)
    with pytest.raises(ValueError):
        detect.staged(pictures, DuplicateSettings(enable_hash=False, enable_embedding=False))
    sized = pictures.withColumn("size", F.lit(5000))
    for name in detect.DETECTORS:
        leader = {names[i]: names[i] for i in names}
        leader |= {names[r["member"]]: names[r["leader"]] for r in detect.by_size(sized, 5, name).collect()}
        assert leader["original.png"] == leader["duplicate.png"] and leader["different.png"] == "different.png"


def test_registered_cascade_checks_structure(spark, sf_dir, monkeypatch):
    """The registered query runs all three stages."""
    used = []
    monkeypatch.setattr(image_queries.detect, "staged", lambda pictures, settings: used.append(settings))
    image_queries.image_duplicates_staged(spark, sf_dir)
    assert used[0].enable_hash and used[0].enable_embedding and used[0].enable_ssim


def test_catalog_and_stream(spark, folder, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/catalog")
    assert catalog.read("images").count() == 0
    query = incremental.index_stream(spark, catalog, str(folder), f"file://{tmp_path}/checkpoint", ("embedding", "hash", "nothing"))
    query.awaitTermination(120)
    assert catalog.read("images").count() == 4 and catalog.read("features").count() == 8
    incremental.index_folder(spark, catalog, str(folder))
    assert catalog.read("images").count() == 4
    assert all(r["ok"] for r in catalog.verify().collect())
    known = catalog.features("embedding").select(F.col("image_id").alias("id"), F.col("feature_vector").alias("vector"))
    path = catalog.read("images").where("file_name = 'original.png'").first()
    best = vectors.knn_join(known, known.where(F.col("id") == path["id"]), 3, id_col="id", vector="vector").collect()
    assert path["id"] in [r["id"] for r in best if r["similarity"] > 0.999]
    assert catalog.image(path["file_path"]).count() == 1
    catalog.write("images", catalog.read("images"))
    assert catalog.read("images").count() == 4


def test_command_line(spark, folder, tmp_path):
    settings = Settings(catalog_dir=f"file://{tmp_path}/catalog")
    args = cli.parser().parse_args(["index", str(folder)])
    assert cli.index(spark, args, settings).first()["indexed"] == 4
    args = cli.parser().parse_args(["search", f"{folder}/original.png", "-k", "2", "-o", f"{tmp_path}/out"])
    assert cli.search(spark, args, settings).count() == 2 and spark.read.json(f"{tmp_path}/out").count() == 2
    args = cli.parser().parse_args(["maintain", "compact"])
    cli.maintain(spark, args, settings)
    backups = list((tmp_path / "catalog/backups").iterdir())
    assert len(backups) == 1 and spark.read.parquet(f"file://{backups[0]}/images").count() == 4
    cells = Settings(catalog_dir=settings.catalog_dir, search=SearchSettings(index_type="ivf", cells=2, probes=2))
    cli.maintain(spark, cli.parser().parse_args(["maintain", "rebuild", "--folder", str(folder)]), cells)
    assert Catalog(spark, settings.catalog_dir).read("images").count() == 4
    args = cli.parser().parse_args(["search", f"{folder}/original.png", "-k", "2"])
    assert [r["path"] for r in cli.search(spark, args, cells).collect()] == [r["path"] for r in cli.search(spark, args, settings).collect()]
    args = cli.parser().parse_args(["duplicates", str(folder), "-r", f"{tmp_path}/report.html"])
    assert cli.duplicates(spark, args, settings).count() >= 1 and "Duplicates" in (tmp_path / "report.html").read_text()


def test_features_and_key_frames(spark, folder):
    loaded = images.load(spark, str(folder))
    own = {"mean": lambda x: [x.mean()]}
    found = images.extract_features(loaded, ("embedding", "hash", "keypoint", "histogram", "mean", "nothing"), extractors=own).collect()
    sizes = {(r["feature_type"], len(r["vector"])) for r in found}
    assert sizes == {("embedding", 192), ("hash", 192), ("keypoint", 128), ("histogram", 512), ("mean", 1)} and len(found) == 20
    assert images.extract_features(loaded, ("nothing",)).count() == 0
    video = loaded.select(F.lit(1).alias("v"), F.row_number().over(Window.orderBy("path")).alias("t"), "image")
    for method, how in (("uniform", {"every": 2}), ("motion", {"threshold": 0.0})):
        assert 1 <= frames.extract(video, method, ["v"], ["t"], F.lit(0), **how).count() <= 4
    with pytest.raises(ValueError):
        frames.extract(video, "other", ["v"], ["t"], F.lit(0))


def test_settings(tmp_path):
    path = f"{tmp_path}/config.yaml"
    assert Settings.load(path) == Settings()
    PROFILES["accuracy"].save(path)
    assert Settings.load(path) == PROFILES["accuracy"]
    (tmp_path / "s.yaml").write_text("system:\n  catalog_dir: \"x\"  # where\nduplicates:\n  hash_threshold: 9\nindex:\n  methods:\n    - hash\n    - embedding\n")
    loaded = Settings.load(f"{tmp_path}/s.yaml")
    assert loaded.catalog_dir == "x" and loaded.duplicates.hash_threshold == 9 and loaded.index.methods == ("hash", "embedding")


def test_metrics(spark, tmp_path):
    log = reports.MetricLog(spark)
    with log.timed("step", rows=3):
        pass
    log.save(f"{tmp_path}/metrics")
    assert spark.read.json(f"{tmp_path}/metrics").count() == 1


@pytest.mark.parametrize("shape", [(1, 1, 3), (1, 9, 1), (7, 1, 3), (40, 31, 3), (33, 70, 4), (64, 64, 1)])
def test_looked_equals_expressions(spark, monkeypatch, shape):
    """Sums, counts and small pictures, strip by strip, give what the expressions over all pixels give."""
    from lumenfold.functions import pixels as P

    monkeypatch.setattr(K, "strips", lambda x, pixels=0: ((y, min(x.shape[0], y + 7)) for y in range(0, x.shape[0], 7)))
    x = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    row = spark.createDataFrame([(0, (*shape, bytearray(x.tobytes())))], "id long, image struct<height: int, width: int, nChannels: int, data: binary>")
    want = row.select(P.sharpness(F.col("image")).alias("s"), P.thumbnail(F.col("image")).alias("t"), P.color_bins(F.col("image")).alias("b"), P.color_bins(F.col("image"), hsv=False).alias("c")).first()
    n, base, s, q, bent, bent2 = K.tone(x)
    got = (bent2 - bent * bent / n) / n, base + s / n, max(0, (q - s * s / n) / n) ** 0.5
    assert np.allclose(got, want["s"], atol=1e-7)
    small = K.shrunk(x, 8).ravel()
    small = small - small.mean()
    assert np.allclose(small / max(1e-12, np.sqrt((small * small).sum())), want["t"], atol=1e-6) or np.abs(small).max() < 1e-9
    assert np.array_equal(K.color_counts(x, True), np.bincount(want["b"], minlength=512)) and np.array_equal(K.color_counts(x, False), np.bincount(want["c"], minlength=512))


def test_large_picture(spark):
    """Twelve megapixels: each look takes under two seconds and less than a gigabyte beside the picture."""
    import time
    import tracemalloc

    x = np.random.default_rng(4).integers(0, 256, (3000, 4000, 3)).astype(np.uint8)
    for look in (K.tone, lambda x: K.color_counts(x, True), lambda x: K.shrunk(x, 8), lambda x: K.small(x, 224)):
        took = []
        for _ in range(2):
            began = time.thread_time()
            look(x)
            took.append(time.thread_time() - began)
        tracemalloc.start()
        look(x)
        assert tracemalloc.get_traced_memory()[1] < 1e9
        tracemalloc.stop()
        assert min(took) < 2, took
