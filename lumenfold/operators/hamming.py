"""Joins of 64-bit hashes by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S

#: Up to this distance hashes meet by bands that are equal; beyond it by bands that are near, or by blocks.
MAX_BAND_DISTANCE = 8
#: Rows of a side of a block.
SIDE = 4_000
#: The widest band, and the most cells that a hash may visit.
WIDEST, MOST_PROBES = 16, 4_096
#: Seconds to send a hash to a cell or block, to compare a pair, and to open a cell: only their ratios matter.
SEND, COMPARE, OPEN = 2e-6, 2.5e-9, 5e-5
#: The most cells that a hash visits in group_pairs(), and seconds to compare a pair that a join makes: bits of real
#: hashes aren't even, so more pairs meet than even bits promise.
MOST_VISITS, JOINED = 128, 1.2e-7


def classes(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(hash, representative, n): equal hashes are one class; its smallest id stands for it."""
    return df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("hash")).agg(F.min(id_col).alias("representative"), F.count("*").alias("n"))


def copies(df: DataFrame, hash_col: str, id_col: str, *, bucket: str | None = None) -> DataFrame:
    """(i, j, distance 0): the members of each class beside its representative i, a row each."""
    keys = [F.col(hash_col).alias("hash"), *([F.col(bucket).alias("g")] if bucket else [])]
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("j"), *keys)
    names = ["hash", *(["g"] if bucket else [])]
    firsts = rows.groupBy(*[F.col(c).alias(f"of_{c}") for c in names]).agg(F.min("j").alias("i"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in names]
    return rows.join(firsts, on).where("i <> j").select("i", "j", F.lit(0).alias("distance"))


def block_pairs(df: DataFrame, distance: int, *, group: str = "g") -> DataFrame:
    """(i, j, distance) within a group, exact for any distance: pairs of blocks of about SIDE hashes, each one task."""
    sizes = df.groupBy(F.col(group).alias("sg")).agg(F.ceil(F.count("*") / SIDE).cast("long").alias("blocks"))
    rows = df.join(sizes, F.col(group).eqNullSafe(F.col("sg"))).select("hash", "representative", F.col(group).alias("g"), "blocks")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("representative"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("hash", "representative", "g", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["own"] == pdf["a"]], pdf[pdf["own"] == pdf["b"]]
        hy, iy, out = y["hash"].to_numpy().view(np.uint64), y["representative"].to_numpy(), []
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        for h, i in zip(x["hash"].to_numpy().view(np.uint64), x["representative"].tolist(), strict=True):
            d = np.bitwise_count(hy ^ h)
            at = np.flatnonzero((d <= distance) & (iy > i if same else iy != i))
            if len(at):
                out.append(pd.DataFrame({"i": np.minimum(iy[at], i), "j": np.maximum(iy[at], i), "distance": d[at].astype(np.int32)}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "distance": []}).astype({"i": np.int64, "j": np.int64, "distance": np.int32})

    return rows.groupBy("g", "a", "b").applyInPandas(compare, "i long, j long, distance int")


def near_bands(distance: int, bits: int, n: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of n bands: two hashes within the distance are within the radius in one of them.  Were
    they further apart in all, their distance would be more than the sum of all radii and n - 1 more."""
    edges, each, rest = [bits * k // n for k in range(n + 1)], distance // n, distance % n
    radii = [each if k <= rest else each - 1 for k in range(n)]
    return [(a, b - a, min(r, b - a)) for a, b, r in zip(edges[:-1], edges[1:], radii, strict=True) if r >= 0]


def probes(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def chosen_bands(n: int, distance: int, bits: int) -> list[tuple[int, int, int]] | None:
    """The bands that promise least work for n hashes, None for blocks.  A hash never visits more than MOST_PROBES cells."""
    best, least = None, n * n / SIDE * SEND + n * n / 2 * COMPARE
    for count in range(-(-bits // WIDEST), distance + 2):
        bands = near_bands(distance, bits, count)
        visits = sum(probes(w, r) for _, w, r in bands)
        cost = n * visits * SEND + n * n * sum(probes(w, r) / 2**w for _, w, r in bands) * COMPARE + sum(min(2**w, n) for _, w, _ in bands) * OPEN
        if visits <= MOST_PROBES and cost < least:
            best, least = bands, cost
    return best


def cell_pairs(reps: DataFrame, distance: int, bands: list[tuple[int, int, int]]) -> DataFrame:
    """(i, j, distance) of classes within the distance, by multi-index hashing: a hash lives in a cell for each band, by
    the band's bits, and visits the cells whose bits differ in `radius` places at most.  A pair is found in several bands
    and kept in the first that it is near in.

    Cells with more than SIDE hashes or visitors are dealt into blocks; small cells share a task.  The driver holds a
    number for each cell, 2**WIDEST for a band at most.
    """
    spark = reps.sparkSession
    value = [F.call_function("shiftrightunsigned", F.col("hash"), F.lit(a)).bitwiseAND(F.lit((1 << w) - 1)) for a, w, _ in bands]
    counted = reps.select(F.posexplode(F.array(*value)).alias("band", "value")).groupBy("band", "value").agg(F.count("*").alias("n")).toPandas()
    masks = [np.array([sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(w), k)], np.int64) for _, w, r in bands]
    homes, guests = [], []
    for k, (_, w, _) in enumerate(bands):
        own = counted[counted["band"] == k]
        n = np.zeros(1 << w, np.int64)
        n[own["value"].to_numpy(np.int64)] = own["n"]
        visitors = np.zeros_like(n)
        for m in masks[k]:
            visitors += n[np.arange(1 << w) ^ m]
        homes.append(-(-n // SIDE))
        guests.append(np.where(n > 0, -(-visitors // SIDE), 0))
    rows = int(counted.groupby("band")["n"].sum().max() if len(counted) else 0) * sum(map(len, masks))
    bins = max(1, -(-rows // 200_000))
    shared = spark.sparkContext.broadcast((bands, masks, homes, guests))

    def spread(batches: Iterator[pd.DataFrame], visiting: bool) -> Iterator[pd.DataFrame]:
        """(bin, key, hash, representative): every hash in its cells, or in those that it visits; key is band, value and
        both blocks."""
        bands, masks, homes, guests = shared.value
        step = max(1, 500_000 // max(len(m) for m in masks)) if visiting else 500_000
        for batch in batches:
            for a in range(0, len(batch), step):
                h, ids = batch["hash"].to_numpy()[a : a + step].view(np.uint64), batch["representative"].to_numpy(np.int64)[a : a + step]
                for k, (low, w, _) in enumerate(bands):
                    cell = ((h >> np.uint64(low)) & np.uint64((1 << w) - 1)).astype(np.int64)
                    at = np.arange(len(h))
                    if visiting:
                        cell, at = (cell[:, None] ^ masks[k][None, :]).ravel(), np.repeat(at, len(masks[k]))
                    own, other = (guests[k][cell], homes[k][cell]) if visiting else (homes[k][cell], guests[k][cell])
                    cell, at, own, other = (x[(own > 0) & (other > 0)] for x in (cell, at, own, other))
                    mine, copies = (ids[at] * 0x9E3779B1 >> 7) % own, np.repeat(np.arange(len(cell)), other)
                    far = np.arange(len(copies)) - np.repeat(np.cumsum(other) - other, other)
                    mine, cell, at = mine[copies], cell[copies], at[copies]
                    guest, home = (mine, far) if visiting else (far, mine)
                    key = (np.int64(k) << 56) | (cell << 40) | (guest << 20) | home
                    yield pd.DataFrame({"bin": (key ^ (key >> 20) * 31 ^ (key >> 40) * 1_000_003) % bins, "key": key, "hash": h[at].view(np.int64), "representative": ids[at]})

    def compare(v: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"i": [], "j": [], "distance": []}).astype({"i": np.int64, "j": np.int64, "distance": np.int32})]
        v, s = v.sort_values("key"), s.sort_values("key")
        keys, first = np.unique(s["key"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(s))
        lo, hi = np.searchsorted(v["key"].to_numpy(), keys), np.searchsorted(v["key"].to_numpy(), keys, "right")
        hv, iv, hs, js = v["hash"].to_numpy().view(np.uint64), v["representative"].to_numpy(), s["hash"].to_numpy().view(np.uint64), s["representative"].to_numpy()
        for key, a, b, c, d in zip(keys.tolist(), lo.tolist(), hi.tolist(), first.tolist(), ends.tolist(), strict=True):
            for e in range(a, b, 1_000):
                x = hv[e : min(e + 1_000, b), None] ^ hs[None, c:d]
                near = np.bitwise_count(x)
                y, z = np.nonzero((near <= distance) & (iv[e : min(e + 1_000, b), None] < js[None, c:d]))
                for low, w, r in bands[: key >> 56]:
                    fresh = np.bitwise_count((x[y, z] >> np.uint64(low)) & np.uint64((1 << w) - 1)) > r
                    y, z = y[fresh], z[fresh]
                if len(y):
                    out.append(pd.DataFrame({"i": iv[e:b][y], "j": js[c:d][z], "distance": near[y, z].astype(np.int32)}))
        return pd.concat(out)

    schema = "bin long, key long, hash long, representative long"
    rows = reps.select("hash", "representative")
    guests_of = rows.mapInPandas(lambda it: spread(it, True), schema).groupBy("bin")
    return guests_of.cogroup(rows.mapInPandas(lambda it: spread(it, False), schema).groupBy("bin")).applyInPandas(compare, "i long, j long, distance int")


def chosen_group_bands(n: int, pairs: float, distance: int, bits: int) -> list[tuple[int, int, int]]:
    """The bands by which n hashes that make so many pairs within their groups meet with least work: more hashes are
    dealt by fewer and wider bands, which a hash visits more cells of."""
    def cost(bands: list[tuple[int, int, int]]) -> float:
        visits = sum(probes(w, r) for _, w, r in bands)
        return n * (visits + len(bands)) * SEND + pairs * sum(probes(w, r) / 2**w for _, w, r in bands) * JOINED

    choices = [near_bands(distance, bits, k) for k in range(distance + 1, 0, -1)]
    return min((bands for bands in choices if sum(probes(w, r) for _, w, r in bands) <= max(MOST_VISITS, distance + 1)), key=cost)


def group_pairs(reps: DataFrame, distance: int, bands: list[tuple[int, int, int]]) -> DataFrame:
    """(i, j, distance) of classes (hash, representative, g) of a group within the distance.  A hash lives in a cell of
    its group for each band, by the band's bits, and visits the cells whose bits differ in `radius` places at most.
    Cells with more than SIDE hashes are dealt into blocks, each of which all visitors of the cell come to."""
    value = lambda a, w: F.call_function("shiftrightunsigned", F.col("hash"), F.lit(a)).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
    masks = lambda w, r: [sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(w), k)]
    lives = F.array(*[F.struct(F.lit(k).alias("band"), value(a, w).alias("value")) for k, (a, w, _) in enumerate(bands)])
    visited = F.array(*[F.struct(F.lit(k).alias("band"), value(a, w).bitwiseXOR(F.lit(m).cast("long")).alias("value")) for k, (a, w, r) in enumerate(bands) for m in masks(w, r)])
    cell = ["g", "band", "value"]
    homes = reps.select("g", F.col("hash").alias("hb"), F.col("representative").alias("j"), F.explode(lives).alias("c")).select("g", "c.*", "hb", "j")
    guests = reps.select("g", F.col("hash").alias("ha"), F.col("representative").alias("i"), F.explode(visited).alias("c")).select("g", "c.*", "ha", "i")
    large = homes.groupBy(*cell).agg(F.ceil(F.count("*") / SIDE).cast("long").alias("blocks")).where("blocks > 1")
    large = F.broadcast(large.select(*[F.col(c).alias(f"of_{c}") for c in cell], "blocks"))  # a row for SIDE hashes at most
    blocks = lambda rows: rows.join(large, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in cell], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).drop(*[f"of_{c}" for c in cell])
    homes = blocks(homes).withColumn("block", F.pmod(F.xxhash64("j"), F.col("blocks"))).drop("blocks")
    guests = blocks(guests).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    homes = homes.select(*[F.col(c).alias(f"of_{c}") for c in (*cell, "block")], "hb", "j")
    same = [F.col(c) == F.col(f"of_{c}") if c != "g" else F.col("g").eqNullSafe(F.col("of_g")) for c in (*cell, "block")]
    close = guests.join(homes, [*same, F.col("i") < F.col("j"), S.hamming("ha", "hb") <= distance])
    return close.select("i", "j", S.hamming("ha", "hb").cast("int").alias("distance")).distinct()


def near_pairs(df: DataFrame, distance: int, *, hash_col: str = "hash", id_col: str = "id", bucket: str | None = None, bits: int = 64) -> DataFrame:
    """(i, j, distance) between classes of equal hashes (within a bucket, where one is given); ids must be numbers.

    Copies of a hash are one class - see classes() - so a hash that a third of the rows share costs one row.  Every
    member has the links of its representative; near_links() gives the members too.
    """
    if bucket:
        reps = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("hash"), F.col(bucket).alias("g")).agg(F.min(id_col).alias("representative"))
    else:
        reps = classes(df, hash_col, id_col).select("hash", "representative", F.lit(0).alias("g"))
    if distance <= MAX_BAND_DISTANCE * bits // 64:
        n, pairs = reps.groupBy("g").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n").cast("double")) / 2).first()
        return group_pairs(reps, distance, chosen_group_bands(n or 0, pairs or 0.0, distance, bits))
    if bucket:
        return block_pairs(reps, distance)
    bands = chosen_bands(reps.count(), distance, bits)
    return cell_pairs(reps, distance, bands) if bands else block_pairs(reps, distance)


def near_links(df: DataFrame, distance: int, *, hash_col: str = "hash", id_col: str = "id", bucket: str | None = None, bits: int = 64) -> DataFrame:
    """(i, j, distance): near_pairs() of representatives, and each representative i with its copies j at distance 0.
    So every id has a row, unless it is near to nothing, and no link between different hashes is lost."""
    pairs = near_pairs(df, distance, hash_col=hash_col, id_col=id_col, bucket=bucket, bits=bits)
    return pairs.unionByName(copies(df, hash_col, id_col, bucket=bucket))


def class_links(df: DataFrame, distance: int, *, hashes: tuple[str, ...] = ("phash", "dhash"), id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, c) and links (c, d) for cluster.leaders_of_classes(): an id is in the class of each of its hashes,
    and classes of one kind are linked if their hashes are near."""
    nodes, links = None, None
    for h in hashes:
        name = lambda c, h=h: F.concat(F.lit(f"{h}:"), F.col(c).cast("string"))
        of_class = classes(df, h, id_col).select("hash", "representative")
        own = df.select(F.col(id_col).alias("id"), F.col(h).alias("hash")).join(of_class, "hash").select("id", name("representative").alias("c"))
        near = near_pairs(df, distance, hash_col=h, id_col=id_col).select(name("i").alias("c"), name("j").alias("d"))
        nodes, links = (own, near) if nodes is None else (nodes.union(own), links.union(near))
    return nodes, links
