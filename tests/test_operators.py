"""Operators against sequential or brute-force versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import cluster, detect, frames, groups, hamming, lifecycle, ordered, stats, stored_index, vectors


def greedy(edges):
    near, leader = {}, {}
    for i, j in edges:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    for i in sorted(near):
        if i not in leader:
            leader[i] = i
            for j in near[i]:
                if j > i and j not in leader:
                    leader[j] = i
    return sorted((v, k) for k, v in leader.items() if v != k)


@pytest.mark.parametrize("shape", ["chain", "star", "clique", "random", "empty"])
def test_leaders_equal_sequential_greedy(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(9)], "star": [(0, i) for i in range(1, 12)], "clique": [(i, j) for i in range(7) for j in range(i + 1, 7)], "random": sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}), "empty": []}[shape]
    got = cluster.leaders(spark.createDataFrame(edges, "i long, j long"))
    assert sorted(map(tuple, got.collect())) == greedy(edges)


def test_leaders_of_long_chains(spark):
    """Each round settles two nodes of a chain; all must be settled, in any number of them."""
    edges = [(i, i + 1) for i in range(3000)] + [(5000, 5001)]
    got = cluster.leaders(spark.createDataFrame(edges, "i long, j long"))
    assert sorted(map(tuple, got.collect())) == greedy(edges)


def test_leaders_of_a_million(spark):
    """A chain of a million and one where each node meets the two before it: by ranges, without the driver."""
    n, rounds = 1_000_000, []
    chain = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    got = cluster.leaders(chain, rounds=rounds)
    assert rounds[0] < 60 and got.count() == n // 2
    assert got.where("leader % 2 = 1 or member <> leader + 1").isEmpty()
    band = spark.range(300_000).select(F.explode(F.array(F.struct(F.col("id").alias("i"), (F.col("id") + 1).alias("j")), F.struct(F.col("id").alias("i"), (F.col("id") + 2).alias("j")))).alias("e")).select("e.*")
    got = cluster.leaders(band, rounds=rounds)
    assert rounds[1] < 60 and got.count() == 200_000 and got.where("leader % 3 <> 0 or member - leader > 2").isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_leaders_in_ranges(spark, monkeypatch, seed):
    """Small ranges from the first round on, with a node that has more earlier neighbours than a range holds."""
    monkeypatch.setattr(cluster, "ROUNDS", 0)
    monkeypatch.setattr(cluster, "RANGE", 40)
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(260)} | {(i, i + 1) for i in range(150)} | {(i, 199) for i in range(1, 190, 2)}
    got = cluster.leaders(spark.createDataFrame(sorted(edges), "i long, j long"))
    assert sorted(map(tuple, got.collect())) == greedy(sorted(edges))


def test_lsh_recall(spark):
    """Nearly all pairs at or above the threshold are found, and no others."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = set(vectors.similar_pairs(df, 0.4).select("i", "j").collect())
    got = set(vectors.lsh_pairs(df, 0.4).select("i", "j").collect())
    assert got <= want and len(got) >= 0.97 * len(want)
    assert vectors.table_count(0.4, 6, 0.95) == 46 and vectors.table_count(1.0, 6, 0.99) == 1


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 8, 12])
def test_near_hashes_equal_brute_force(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    planted = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, distance + 2), replace=False)) for b in base]
    values = [int(b) for b in base] + planted
    rows = [(i, v) for i, v in enumerate(values)]
    first = {}
    for i, v in rows:
        first.setdefault(v, i)
    want = sorted((i, j) for v, i in first.items() for w, j in first.items() if i < j and bin((v ^ w) & (2**64 - 1)).count("1") <= distance)
    got = hamming.near_pairs(spark.createDataFrame(rows, "id long, hash long"), distance)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


@pytest.mark.parametrize(("distance", "count"), [(3, 4), (12, 4), (12, 6), (18, 5), (24, 6), (24, 8)])
def test_near_bands_equal_brute_force(spark, monkeypatch, distance, count):
    """Multi-index hashing with small blocks, where a third of all hashes share a band's bits."""
    monkeypatch.setattr(hamming, "SIDE", 20)
    rng = np.random.default_rng(distance)
    base = rng.integers(-(2**63), 2**63 - 1, 120)
    planted = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, distance + 2), replace=False)) for b in base]
    values = list(dict.fromkeys([int(b) for b in base] + planted + [(int(b) & ~0xFFFF) | 0x1234 for b in base]))
    want = sorted((i, j, bin((v ^ w) & (2**64 - 1)).count("1")) for i, v in enumerate(values) for j, w in enumerate(values) if i < j and bin((v ^ w) & (2**64 - 1)).count("1") <= distance)
    reps = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "hash long, representative long")
    got = hamming.cell_pairs(reps, distance, hamming.near_bands(distance, 64, count))
    assert sorted(map(tuple, got.collect())) == want


def test_chosen_bands():
    """Bands beat blocks for many hashes, and no hash visits more cells than the bound; radii cover the distance."""
    assert hamming.chosen_bands(1_000, 12, 64) is None
    for n, distance in ((3_000_000, 10), (10_000_000, 12), (100_000_000, 16)):
        bands = hamming.chosen_bands(n, distance, 64)
        assert bands and sum(hamming.probes(w, r) for _, w, r in bands) <= hamming.MOST_PROBES
        assert sum(r + 1 for _, _, r in bands) > distance and sum(w for _, w, _ in bands) <= 64
    assert hamming.near_bands(3, 64, 4) == [(0, 16, 0), (16, 16, 0), (32, 16, 0), (48, 16, 0)]


def test_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SIDE", 7)
    monkeypatch.setattr(hamming, "SIDE", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 6))
    rows = [(i, [float(x) for x in v[i]], i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for group in (None, "g"):
        want = sorted((i, j) for i in range(50) for j in range(i + 1, 50) if unit[i] @ unit[j] >= 0.5 and (group is None or i % 2 == j % 2))
        assert sorted((r["i"], r["j"]) for r in vectors.similar_pairs(df, 0.5, group=group).collect()) == want


def test_knn(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(80)], "vec_id long, embedding array<double>")
    d = ((v[:, None] - v[None]) ** 2).sum(axis=2)
    want = {q: np.lexsort((np.arange(80), d[q]))[:3].tolist() for q in range(0, 80, 10)}
    for block in (20_000, 3):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        got = vectors.knn_join(df, df.where("vec_id % 10 = 0"), 3).collect()
        assert {q: [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want
        assert all(r["similarity"] == 1 for r in got if r["rank"] == 1)
    assert vectors.knn_join(df, df.where("vec_id = 0"), 500).count() == 80
    full = vectors.ivf_search(df, df.where("vec_id % 10 = 0"), 3, n_cells=4, probes=4).collect()
    assert {q: [r["id"] for r in sorted(full, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == want


def test_ivf_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = df.where("vec_id % 10 = 0")
    exact = {(r["query_id"], r["id"]) for r in vectors.knn_join(df, q, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vectors.ivf_search(df, q, 10, n_cells=16, probes=12).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_quantize_and_pca(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert [r["codes"] for r in vectors.quantized(df).orderBy("vec_id").collect()] == [[0, 255], [128, 64]]
    assert len(vectors.pca(df, 1).collect()) == 2


def test_ordered(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(u, base + datetime.timedelta(hours=7 * k), k, float(k * k)) for u in (1, None) for k in range(20)]
    df = spark.createDataFrame(rows, "u long, ts timestamp, k long, v double")
    day = ordered.day_bucket("ts")
    got = ordered.with_index(df, ["u"], ["ts", "k"], day).collect()
    assert len(got) == 40 and all(r["k"] == r["frame_idx"] for r in got)
    got = ordered.with_previous(df, ["u"], ["ts", "k"], "v", day).collect()
    assert all(r["previous"] == (None if r["k"] == 0 else (r["k"] - 1) ** 2) for r in got)
    got = ordered.with_running_sum(df, ["u"], ["ts", "k"], F.col("k"), day, "s").collect()
    assert all(r["s"] == r["k"] * (r["k"] + 1) // 2 for r in got)
    one = frames.scene_segments(df.where("u = 1 and k = 0"), ["u"], ["ts", "k"], "v", day, cut=lambda p, c: c != p).collect()
    assert [(r["start_frame"], r["end_frame"]) for r in one] == [(0, 1)]
    assert frames.scene_segments(df.where("k < 0"), ["u"], ["ts", "k"], "v", day, cut=lambda p, c: c != p).count() == 0


def test_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "a")], "id long, k string")
    edges = groups.edges(df, F.col("k"), "id")
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 6)]
    left = groups.after_delete(edges, spark.createDataFrame([(1,)], "id long"))
    assert sorted(map(tuple, left.collect())) == [(2, 6)]
    assert groups.after_delete(edges, spark.createDataFrame([(1,), (2,)], "id long")).count() == 0
    tied = spark.createDataFrame([(1, 7, 1.0), (2, 7, 3.0), (3, 7, 3.0)], "id long, g long, s double")
    assert groups.best_of_group(tied, "g", F.col("s"), "id").first()["best"] == 2
    plan = groups.clean_plan(tied.withColumn("size", F.lit(10)), "g", F.col("s"), "id")
    assert tuple(groups.clean_summary(plan, "g", "size").first()) == (1, 2, 20)


def test_sizes(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (2047,), (1536,)], "size long")
    assert [r[0] for r in df.orderBy("size").select(S.kb_bucket("size")).collect()] == [0, 0, 1024, 1024, 1024]
    assert groups.size_blocks(df, "size").count() == 3 and groups.size_blocks(df, "size", skip_empty=False).count() == 5
    assert df.orderBy("size").select(S.human_size("size")).first()[0] == "0.00 B"
    texts = spark.createDataFrame([("a/b\\c*?.png",), ("x" * 300 + ".jpeg",)], "n string").select(S.sanitize_filename("n")).collect()
    assert texts[0][0] == "a_b_c.png" and texts[1][0] == "x" * 250 + ".jpeg"


def test_median(spark):
    rows = [("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 4.0), ("b", 4.5), ("b", 9.0), ("c", None)]
    got = stats.exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert {r["k"]: r["median_value"] for r in got} == {"a": 2.0, "b": 4.25}


def test_lifecycle(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    files = spark.createDataFrame([(f"{tmp_path}/a.png",)], "path string")
    plan = lifecycle.delete_plan(files, f"{tmp_path}/trash", "2024-01-02 03:04:05")
    assert [o for *_, o in lifecycle.apply(plan)] == ["planned"] and (tmp_path / "a.png").exists()
    log = spark.createDataFrame(plan.collect(), plan.schema)
    assert [o for *_, o in lifecycle.apply(plan, dry_run=False)] == ["done"] and (tmp_path / "trash/20240102_030405_a.png").exists()
    back = lifecycle.restore_plan(log, spark.createDataFrame([("a.png",)], "name string"), "2024-01-03")
    assert [o for *_, o in lifecycle.apply(back, dry_run=False)] == ["done"] and (tmp_path / "a.png").exists()
    assert lifecycle.is_allowed_folder(str(tmp_path)) and not lifecycle.is_allowed_folder("/etc")


@pytest.mark.parametrize("distance", [1, 18])
def test_equal_hashes_keep_their_links(spark, distance):
    df = spark.createDataFrame([(0, 5, 1), (1, 5, 1), (2, 7, 1), (3, 1 << 40, 2), (4, None, 2), (5, 7, 2)], "id long, hash long, g int")
    got = sorted(map(tuple, hamming.near_links(df, distance).select("i", "j", "distance").collect()))
    near = [(0, 1, 0), (0, 2, 1), (2, 5, 0)]
    assert got == sorted(near + ([(0, 3, 3), (2, 3, 4)] if distance == 18 else []))
    got = sorted(map(tuple, hamming.near_links(df, distance, bucket="g").select("i", "j", "distance").collect()))
    assert got == sorted([(0, 1, 0), (0, 2, 1)] + ([(3, 5, 4)] if distance == 18 else []))


def test_bands_of_short_hashes(spark):
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(i, int(h)) for i, h in enumerate(rng.integers(0, 1 << 16, 300))], "id long, hash long")
    reps = hamming.classes(df, "hash", "id").collect()
    want = sorted((a["representative"], b["representative"]) for a in reps for b in reps if a["representative"] < b["representative"] and bin(a["hash"] ^ b["hash"]).count("1") <= 2)
    assert sorted((r["i"], r["j"]) for r in hamming.near_pairs(df, 2, bits=16).collect()) == want


def greedy_by_hashes(rows, threshold):
    """Sequential clustering by either hash, after groups of equal first hashes."""
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") > threshold
    by_p = {}
    for i, p, _ in rows:
        by_p.setdefault(p, []).append(i)
    out = [(g[0], m) for g in by_p.values() if len(g) > 1 for m in g[1:]]
    leaders = []
    for i, p, d in sorted(r for r in rows if len(by_p[r[1]]) == 1):
        for j, q, e in leaders:
            if not far(p, q) or not far(d, e):
                out.append((j, i))
                break
        else:
            leaders.append((i, p, d))
    return sorted(out)


def test_hash_groups_keep_copies_by_one_hash(spark):
    x, y = (1 << 62) - 1, 0x5555 << 40
    rows = [(0, 0, 0), (1, x, 1), (2, y, 1)]
    got = detect.hash_groups(spark.createDataFrame(rows, "id long, phash long, dhash long"), 1)
    assert sorted(map(tuple, got.collect())) == greedy_by_hashes(rows, 1) == [(0, 1), (0, 2)]
    rng = np.random.default_rng(21)
    few = [int(h) for h in rng.integers(0, 1 << 62, 12)]
    rows = [(i, few[rng.integers(12)] ^ int(1 << rng.integers(50)) if i % 3 else int(rng.integers(0, 1 << 62)), few[rng.integers(12)] ^ int(rng.integers(0, 4))) for i in range(150)]
    got = detect.hash_groups(spark.createDataFrame(rows, "id long, phash long, dhash long"), 2)
    assert sorted(map(tuple, got.collect())) == greedy_by_hashes(rows, 2)


def test_long_chains_of_classes(spark):
    """Each class is near the next one: few nodes are settled a round."""
    n = 600
    nodes = spark.createDataFrame([(i, f"c{i // 2}") for i in range(2 * n)], "id long, c string")
    links = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n - 1)], "c string, d string")
    got = cluster.leaders_of_classes(nodes, links)
    want = greedy([(i, j) for i in range(2 * n) for j in range(i + 1, min(2 * n, i // 2 * 2 + 4))])
    assert sorted(map(tuple, got.collect())) == want


def test_knn_ties_and_copies(spark, monkeypatch):
    """A third of all vectors are one vector: ids decide, and rounding doesn't."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 8)) * 1e3
    v[::3] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "SPARE", 1)
    for metric in ("l2", "cosine"):
        got = vectors.knn_join(df, df.where("vec_id in (0, 7, 9)"), 5, metric=metric).orderBy("query_id", "rank").collect()
        assert [r["id"] for r in got if r["query_id"] != 7] == [0, 3, 6, 9, 12] * 2
        assert [r["id"] for r in got if r["query_id"] == 7][0] == 7 and all(abs(r["similarity"] - 1) < 1e-9 for r in got if r["rank"] == 1)
    some = df.withColumn("embedding", F.when(F.col("vec_id") != 5, F.col("embedding")))
    assert vectors.knn_join(some, some.where("vec_id in (4, 5)"), 400).count() == 299 and vectors.knn_join(some.limit(0), some, 2).count() == 0


def test_stored_index(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    stored_index.create(df, f"file://{tmp_path}/index", n_cells=8)
    indexed, centres = stored_index.read(spark, f"file://{tmp_path}/index")
    q = df.where("vec_id % 50 = 0")
    assert indexed.count() == df.count() and len(centres) == 8
    full = vectors.search_cells(indexed, centres, q, 5, probes=8)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, vectors.knn_join(df, q, 5).collect()))
    one = vectors.search_cells(indexed, centres, df.where("vec_id = 0"), 5, probes=1)
    assert one.orderBy("rank").first()["id"] == 0


def test_embedding_groups_without_pairs(spark):
    """Groups with copies, zero vectors and ids in two groups, against the sequential rule over all pairs."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3)).round(3)
    v[::3], v[1::20] = v[0], 0
    groups_of = [(int(g), i) for i in range(60) for g in {i % 4, (i // 7) % 4 if i % 5 == 0 else i % 4}]
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    edges = sorted({(i, j) for g, i in groups_of for h, j in groups_of if g == h and i < j and unit[i] @ unit[j] >= 0.7})
    features = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "id long, vector array<double>")
    got = detect.embedding_groups(spark.createDataFrame(groups_of, "group_id long, id long"), features, 0.7)
    assert sorted(map(tuple, got.collect())) == greedy(edges)


def test_ranked_lines_round_as_sql(spark, tmp_path):
    """Similarities of 0.5135 and 0.5145 are halves of a tenth of a percent, which the product with 100 misses by its last bit."""
    import duckdb

    from lumenfold.plans import registry

    rows = [(100 * i + k, [float(10 * i + (1 / s - 1) ** 0.5 * (k > 0))], 0) for i in range(2) for k, s in enumerate((1, 0.5135 + i / 1000, 0.3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["ranked_lines"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLE_SQL["ranked_lines"]).fetchall())


@pytest.mark.parametrize(("distance", "count"), [(0, 1), (3, 2), (5, 3), (5, 4), (5, 6)])
def test_group_pairs_equal_brute_force(spark, monkeypatch, distance, count):
    """Bands within groups, one of them null, with cells of more hashes than a block has."""
    monkeypatch.setattr(hamming, "SIDE", 10)
    rng = np.random.default_rng(count)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    values = [int(b) for b in base] + [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, distance + 2), replace=False)) for b in base] + [(int(b) & ~0xFFFFFF) | 0x1234 for b in base]
    rows = [(v, i, (None, 1, 2)[i % 60 % 3]) for i, v in enumerate(dict.fromkeys(values))]
    far = lambda v, w: bin((v ^ w) & (2**64 - 1)).count("1")
    want = sorted((i, j, far(v, w)) for v, i, g in rows for w, j, h in rows if i < j and g == h and far(v, w) <= distance)
    got = hamming.group_pairs(spark.createDataFrame(rows, "hash long, representative long, g int"), distance, hamming.near_bands(distance, 64, count))
    assert sorted(map(tuple, got.collect())) == want


def test_chosen_group_bands():
    """Hashes in one group meet as many others as they are sent to cells, about, whatever their number; equal bands suffice for few."""
    assert hamming.chosen_group_bands(1_000, 5e5, 5, 64) == hamming.near_bands(5, 64, 6)
    for n in (1_000_000, 4_000_000):
        bands = hamming.chosen_group_bands(n, n * n / 2, 5, 64)
        assert sum(hamming.probes(w, r) for _, w, r in bands) <= hamming.MOST_VISITS
        assert n / 2 * sum(hamming.probes(w, r) / 2**w for _, w, r in bands) < 1_000


def test_detectors_look_at_pictures_once(spark):
    """Hashes are read several times, pixels are not: each stage looks at a picture once, and none at all for a hash again."""
    from pyspark.sql import functions

    looks, n = spark.sparkContext.accumulator(0), 40

    @functions.udf("struct<height: int, width: int, nChannels: int, data: binary>")
    def picture(i):
        looks.add(1)
        return (12, 32, 1, bytes(np.random.default_rng(i // 2).integers(0, 256, 384).astype(np.uint8)))

    rows = spark.range(0, n, 1, 2).select("id", F.lit(5000).cast("long").alias("size"), picture("id").alias("image"))
    assert detect.by_size(rows).count() == n // 2 and looks.value == n
    looks.value = 0
    assert detect.staged(rows.select("id", "image")).count() == n // 2 and looks.value <= 5 * n


def test_bucket_mates_equal_buckets(spark, monkeypatch):
    """Few planes: rows meet as blocks, are not sent to every bucket, and give the pairs of the buckets."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(vectors, "WIDE_SIDE", 70)
    monkeypatch.setattr(vectors, "STEP_ROWS", 16)
    monkeypatch.setattr(vectors, "STEP_COLS", 32)
    normal, v = np.random.default_rng(11).normal(size=(40, 8)), np.array([r[1] for r in rows[:301]])
    marks = ((v @ normal.T >= 0).reshape(-1, 10, 4) << np.arange(4)).sum(axis=2)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    want = {(i, j) for i in range(301) for j in range(i + 1, 301) if unit[i] @ unit[j] >= 0.4 and (marks[i] == marks[j]).any()}
    found = vectors.lsh_pairs(df, 0.4, tables=10, planes=4)
    got = [(r["i"], r["j"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "__bucket" not in found._jdf.queryExecution().toString()


def test_nearest_copies_few_candidates():
    """Many queries beside few vectors take no more memory than beside many."""
    import tracemalloc

    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(8_192, 64)), rng.normal(size=(100, 64))
    tracemalloc.start()
    vectors.nearest(q, v, np.arange(100), 3, "cosine")
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_color_bins_leave_python_sparse(spark):
    """A picture of 64 pixels hands on 64 bins at most, of 512."""
    from lumenfold.sources import images

    pixels = bytes(range(0, 256, 4))
    one = spark.createDataFrame([(0, (8, 8, 1, bytearray(pixels))), (1, None)], "id long, image struct<height: int, width: int, nChannels: int, data: binary>")
    seen = one.select("id", images.looked("colors", hsv=False)(F.col("image")).alias("c")).collect()
    assert {r["id"]: len(r["c"]["bins"] or []) if r["c"] else 0 for r in seen} == {0: 8, 1: 0}
    got = images.histograms(one, ["id"], hsv=False).collect()
    assert len(got) == 1 and np.isclose(sum(x * x for x in got[0]["vector"]), 1)
