"""The stored index: growth in place, replacement, splits, interruptions, codes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import stored_index, vectors
from lumenfold.sources import tables


def files(folder):
    """Paths and inodes of the data files, by cell."""
    out = {}
    for top, _, names in os.walk(f"{folder}/vectors"):
        for n in names:
            if n.endswith(".parquet"):
                out.setdefault(int(top.rsplit("cell=", 1)[1]), set()).add((n, os.stat(f"{top}/{n}").st_ino))
    return out


@pytest.fixture
def parts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return df.where("vec_id % 10 <> 0"), df.where("vec_id % 10 = 0"), df


def exact(spark, folder, df):
    """Search with all probes equals the join with all vectors."""
    indexed, centres = stored_index.read(spark, folder)
    q = df.where("vec_id % 25 = 0")
    full = vectors.search_cells(indexed, centres, q, 5, probes=len(centres))
    return sorted(map(tuple, full.collect())) == sorted(map(tuple, vectors.knn_join(df, q, 5).collect()))


@pytest.mark.parametrize("codes", [0, 16])
def test_add(spark, tmp_path, parts, codes):
    folder, (first, more, df) = f"file://{tmp_path}/index", parts
    stored_index.create(first, folder, n_cells=8, parts=codes)
    before = files(tmp_path / "index")
    some = more.where("vec_id % 50 = 0")
    done = stored_index.add(some, folder)
    after = files(tmp_path / "index")
    assert done["rewritten"] == done["split"] == [] and 0 < len(done["appended"]) <= 8
    assert all(before[c] <= after[c] for c in before) and {c for c in after if after[c] != before.get(c)} == set(done["appended"])
    stored_index.add(more, folder)
    assert exact(spark, folder, df)
    before = files(tmp_path / "index")
    assert stored_index.add(more, folder) == {"appended": [], "rewritten": [], "split": []} and files(tmp_path / "index") == before


def test_replace(spark, tmp_path, parts):
    folder, (_, _, df) = f"file://{tmp_path}/index", parts
    stored_index.create(df, folder, n_cells=8)
    moved = df.where("vec_id = 7").withColumn("embedding", F.transform("embedding", lambda x: -x))
    odd = spark.createDataFrame([(7, None), (7, [0.0] * 64)], df.schema).union(moved)
    before = files(tmp_path / "index")
    done = stored_index.add(moved, folder)
    after = files(tmp_path / "index")
    assert len(done["rewritten"]) == 1 and all(before[c] <= after.get(c, set()) for c in before if c not in done["rewritten"])
    assert exact(spark, folder, df.where("vec_id <> 7").union(moved))
    stored_index.add(odd, folder)
    assert stored_index.read(spark, folder)[0].where("id = 7").count() == 1


def test_split(spark, tmp_path):
    """A cell of two crowds is split, one of equal vectors isn't, others keep their files."""
    rng = np.random.default_rng(3)
    v = [[float(x) for x in c] for c in np.vstack((rng.normal(size=(30, 4)), 100 + rng.normal(size=(30, 4))))]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    folder = f"file://{tmp_path}/index"
    stored_index.create(df, folder, n_cells=2, parts=2)
    before = files(tmp_path / "index")
    crowd = spark.createDataFrame([(100 + i, [100.0 + 9 * (i % 2), 100.0, 100.0, float(i % 5)]) for i in range(80)], df.schema)
    done = stored_index.add(crowd, folder, most=60)
    after, (indexed, centres) = files(tmp_path / "index"), stored_index.read(spark, folder)
    assert len(done["split"]) == 1 and len(centres) > 2 and indexed.count() == 140
    other = next(c for c in before if c not in done["split"])
    assert before[other] == after[other] and exact(spark, folder, df.union(crowd))
    assert indexed.where("code is null").isEmpty()
    same = spark.createDataFrame([(1000 + i, [-500.0] * 4) for i in range(70)], df.schema)
    stored_index.create(same, folder, n_cells=1)
    assert stored_index.split(spark, folder, 60) == []


def test_interrupted(spark, tmp_path, parts, monkeypatch):
    """Rows that wait beside the table are put in place by the next reader; an interrupted addition may be repeated."""
    folder, (_, _, df) = f"file://{tmp_path}/index", parts
    stored_index.create(df, folder, n_cells=4)
    moved = df.where("vec_id % 40 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x))
    with monkeypatch.context() as m:
        m.setattr(tables, "recover", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stored_index.add(moved, folder)
    stored_index.add(moved, folder)
    assert exact(spark, folder, df.where("vec_id % 40 <> 3").union(moved))


def test_codes(spark, tmp_path):
    """Recall of ten neighbours by codes of an eighth of the bytes, against the exact join."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q, folder = df.where("vec_id % 20 = 0"), f"file://{tmp_path}/index"
    stored_index.create(df, folder, n_cells=8, parts=32)
    indexed, _ = stored_index.read(spark, folder)
    assert indexed.select(F.max(F.length("code"))).first()[0] * 8 <= 64 * 4
    want = {(r["query_id"], r["id"]) for r in vectors.knn_join(df, q, 10).collect()}
    got = stored_index.search_codes(spark, folder, q, 10, probes=8).collect()
    assert len(got) == len(want) and len({(r["query_id"], r["id"]) for r in got} & want) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        stored_index.create(df, folder, n_cells=2, parts=7)
