"""Plans in tasks, reports of all groups, metrics of streams, models in batches."""

import datetime
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.operators import lifecycle
from lumenfold.sources import images, reports
from lumenfold.sources.catalog import Catalog
from lumenfold.streaming import incremental
from tests.test_images import folder, png  # noqa: F401

WHEN = "2024-05-01 12:00:00"


def test_ten_thousand_files(spark, tmp_path):
    """A plan on several tasks; a second run does nothing; restoring brings all back."""
    top, log = tmp_path / "files", f"file://{tmp_path}/log"
    top.mkdir()
    for i in range(10_000):
        (top / f"f{i}").write_bytes(b"x")
    files = spark.range(10_000).select(F.concat(F.lit(f"{top}/f"), "id").alias("path"))
    plan = lifecycle.delete_plan(files, f"{tmp_path}/trash", WHEN)
    assert lifecycle.execute(plan, log).where("outcome = 'planned'").count() == 10_000 and len(os.listdir(top)) == 10_000
    done = lifecycle.execute(plan, log, dry_run=False, tasks=7)
    assert done.where("outcome = 'done'").count() == 10_000 and os.listdir(top) == [] and len(os.listdir(tmp_path / "trash")) == 10_000
    assert len([n for n in os.listdir(tmp_path / "log") if n.endswith(".parquet")]) > 3
    assert lifecycle.execute(plan, log, dry_run=False).count() == 0
    names = spark.range(10_000).select(F.concat(F.lit("f"), "id").alias("name"))
    back = lifecycle.restore_plan(spark.read.parquet(log), names, "2024-05-02 12:00:00")
    assert lifecycle.execute(back, log, dry_run=False).where("outcome = 'done'").count() == 10_000 and len(os.listdir(top)) == 10_000


def test_outcomes(spark, tmp_path):
    """Missing and taken files, removal, URIs, what a lost task has done already."""
    for n in ("a", "b", "c", "taken"):
        (tmp_path / n).write_text(n)
    (tmp_path / "moved").write_text("m")
    at, d = datetime.datetime(2024, 1, 1), str(tmp_path)
    rows = [("trash", f"{d}/a", f"{d}/trash/a"), ("trash", f"file://{d}/b", f"file://{d}/trash/deep/b"), ("trash", f"{d}/none", f"{d}/trash/none"), ("trash", f"{d}/c", f"{d}/taken"), ("restore", f"{d}/gone", f"{d}/moved"), ("remove", f"{d}/none", None), ("remove", f"{d}/a2", None)]
    plan = spark.createDataFrame([(*r, at) for r in rows], lifecycle.PLAN)
    got = {(r["operation"], r["source"].rsplit("/", 1)[1]): r["outcome"] for r in lifecycle.execute(plan, f"file://{d}/log", dry_run=False).collect()}
    assert [k for k, v in got.items() if v != "done"] and {k: v for k, v in got.items() if v != "done"} == {("trash", "none"): "error: no such file", ("trash", "c"): "error: the destination is taken"}
    assert (tmp_path / "trash/a").read_text() == "a" and (tmp_path / "trash/deep/b").exists() and (tmp_path / "taken").read_text() == "taken"
    assert lifecycle.execute(plan, f"file://{d}/log", dry_run=False).count() == 2


def test_report_has_all_groups(spark, tmp_path):
    groups = spark.range(2500).select(F.concat(F.lit("<p"), "id").alias("leader"), F.lit(2).alias("n"), (F.col("id") % 7).alias("bytes_saved"), F.lit("1 B").alias("size_text"))
    assert reports.html_report(groups, {"groups": 2500}, f"{tmp_path}/r.html") == 3
    pages = [(tmp_path / n).read_text() for n in ("r.html", "r-2.html", "r-3.html")]
    assert len({x for p in pages for x in re.findall("&lt;p[0-9]+", p)}) == 2500 and 'href="r-2.html"' in pages[0] and "<ul>" not in pages[1]
    assert reports.html_report(groups.limit(0), {}, f"{tmp_path}/none.html") == 1


def test_stream_progress(spark, folder, tmp_path):  # noqa: F811
    """One row a batch, with counts and durations; and a stored index that the stream keeps."""
    catalog, log = Catalog(spark, f"file://{tmp_path}/catalog"), f"file://{tmp_path}/metrics"
    with reports.StreamProgress(spark, log) as progress:
        incremental.index_stream(spark, catalog, str(folder), f"file://{tmp_path}/checkpoint", index=f"file://{tmp_path}/index", n_cells=2, log=progress.log).awaitTermination(120)
    rows = spark.read.schema(reports.METRICS).json(log).collect()
    batches = [r["metadata"] for r in rows if r["operation"] == "index_batch"]
    assert sum(int(m["decoded"]) for m in batches) == 4 and sum(int(m["bytes"]) for m in batches) == 4 * 96 * 96 * 3
    streamed = [r for r in rows if r["operation"] == "stream_batch"]
    assert streamed and all(r["duration"] > 0 for r in rows) and any("ms.addBatch" in r["metadata"] for r in streamed)
    assert spark.read.parquet(f"file://{tmp_path}/index/vectors").count() == 4


def counting_model(folder):
    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")

        def predict(pictures):
            with open(f"{folder}/sizes", "a") as f:
                f.write(f"{pictures.shape}\n")
            return pictures.mean(axis=(1, 2))

        return predict

    return load


def test_batch_model(spark, folder, tmp_path):  # noqa: F811
    """Loaded once a worker, batches of 32, the same vectors as picture by picture."""
    loaded = images.load(spark, str(folder))
    many = loaded.crossJoin(spark.range(25)).select(F.concat("path", F.lit("#"), "id").alias("path"), "image").coalesce(1)
    model = images.BatchModel(counting_model(str(tmp_path)), side=24)
    got = images.extract_features(many, ("model",), enhance=False, extractors={"model": model}).collect()
    own = {r["path"]: K.small(K.decode(r["image"]), 24).mean(axis=(0, 1)) for r in loaded.collect()}
    assert len(got) == 100 and all(np.allclose(r["vector"], own[r["path"].split("#")[0]], atol=1e-6) for r in got)
    assert (tmp_path / "loads").read_text().count("\n") == 1
    assert (tmp_path / "sizes").read_text().count("(32, 24, 24, 3)") == 3


@pytest.mark.parametrize("shape", [(3000, 4000, 3), (5, 7, 1), (40, 3, 4)])
def test_small_pictures(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    got = K.small(x, 8)
    colors = x[:, :, :3] if shape[2] >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
    want = colors if shape[0] > 1000 else K.resize(colors, 8, 8) / 255
    assert got.shape == (8, 8, 3) and (shape[0] > 1000 or np.allclose(got, want, atol=1e-5))
