"""Near-duplicate detection: chosen-path set similarity join over minhashes.

A document's set is its distinct word shingles.  Documents with equal sets fall together first; what follows works
on one representative of each set.

1. Trees.  A tree's root branches all members, and a node of more than `small` members branches again, up to
`max_depth` times: each child names a minhash position, and members with the same minwise token there go into the same
node below it.  A node has 1 / threshold children on average, so that a pair at the threshold keeps one common child;
other pairs part.  Independent trees make up for pairs that part by chance; their number follows from the target recall
and the depth.
2. Small nodes are compared exhaustively by sketch; members that look alike form clusters, and a cluster found in
several nodes counts once.
3. A node whose parent has lost fewer members than a pair at the threshold would part by is a crowd: branching it again
would make more rows, not smaller nodes.  So is one that is large at the last level.  Members of crowds are first linked,
exactly, within blocks that share some pivots, each member in one node only.  What that leaves apart meets by prefixes
of full sets: shingles ordered from rare to frequent, a pair at the threshold shares one of the first 15 % of one set
and 8 % of the other (at 85 %).  Shingles of a template that most members share are the last in that order; they
reach a prefix as an entry to be looked up only where a template makes 92 % of a set, and such sets link.  Shingles
whose members are linked already are left out; positions and sizes rule out most of the other pairs.
4. Clusters and pairs are compared exactly, on full sets; links that reach the threshold join components.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import forget, fresh, release, shared_dir, small_side, stash
from lumenfold.llm.substring_dedup import NO_ID
from lumenfold.llm.textnp import byte_codes, lower, mix, range_digests, ranges, text_chunks, window_hash, words

#: Minhash positions, and how many must agree for an exact comparison (five deviations below 85 %).
POSITIONS, AGREE = 64, 40
#: Members that meet all others of a crowded node, and members of a node that meet as pivots of any node, at most.
#: Both only save comparisons: prefixes decide about all that is left apart.
PIVOTS, MEETING = 8, 64
#: Shingles whose frequency orders prefixes, at most (9 MB are broadcast); others count as rare.  Any order is right.
FREQUENT = 1 << 20
#: Rows of crowds, clusters and links that are broadcast to spare a shuffle of what they are joined with, at most (some
#: 25 MB); more are shuffled.
FEW = 250_000
RESULT = ("n_shingles", "component_id", "kept")
SIGNATURE = "id long, n_shingles long, s1 long, s2 long, mh array<int>"
_MULTIPLY = byte_codes(11)[:POSITIONS] | np.uint64(1)
_ADD = byte_codes(12)[:POSITIONS]


def near(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of df, which has at most `rows` rows, if these are few."""
    return F.broadcast(df) if rows <= FEW else df


def shingle_sets(batch, shingle: int):
    """For each chunk of (id, text): ids, distinct shingles as two 64-bit hashes, sorted by the first within each
    text, and the texts' bounds."""
    ids = np.asarray(batch.column(0))
    for first, data, offsets in text_chunks(batch.column(1)):
        data = lower(data)
        starts, ends, of = words(data, offsets)
        n = np.diff(of)
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        doc = np.repeat(np.arange(len(n)), count)
        at = ranges(of[:-1], count)
        lanes = []
        for h in range_digests(data, starts, ends):
            hashes = window_hash(h, shingle)[at] if len(h) else h
            for m in range(1, shingle):  # texts of fewer words are one shingle
                short = n[doc] == m
                if short.any():
                    hashes[short] = mix(window_hash(h, m)[at[short]] + np.uint64(m))
            lanes.append(hashes)
        order = np.argsort(lanes[0])
        order = order[np.argsort(doc[order], kind="stable")]
        hashes, doc = lanes[0][order], doc[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))[: len(doc)]
        yield ids[first : first + len(n)], hashes[new], lanes[1][order][new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def sign(batches, shingle: int):
    """mapInArrow: (id, text) to SIGNATURE; texts without words have no minhashes."""
    for batch in batches:
        for ids, hashes, more, bounds in shingle_sets(batch, shingle):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            at = bounds[:-1][full]
            sums = np.zeros((2, len(n)), np.uint64)
            mh = np.zeros((len(full), POSITIONS), np.uint32)
            if len(full):
                for k, lane in enumerate((hashes, more)):
                    sums[k, full] = np.add.reduceat(mix(lane ^ _ADD[k]), at)
                for k in range(POSITIONS):
                    mh[:, k] = np.minimum.reduceat((hashes * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32), at)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n > 0) * POSITIONS)), pa.int32()), pa.array(mh.reshape(-1).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], names=["id", "n_shingles", "s1", "s2", "mh"])


def full_sets(batches, shingle: int):
    """mapInArrow: (id, text) to (id, set), the sorted shingle hashes as bytes."""
    for batch in batches:
        for ids, hashes, _, bounds in shingle_sets(batch, shingle):
            data = hashes.view(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())], names=["id", "set"])


def whole_groups(batches, key: str):
    """The rows of sorted batches, cut so that no key runs over a cut."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def roots_of(near: np.ndarray) -> np.ndarray:
    """For each member the least member that it is linked with, directly or not; near is a symmetric matrix."""
    root = np.arange(len(near))
    while True:
        least = np.where(near, root[None, :], len(near)).min(axis=1)
        least = np.minimum(least, root)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def sketch_clusters(batches, agree: int):
    """mapInArrow over rows sorted by node: (node, id, label, mh) to (cluster, id): members of a node that agree in
    `agree` positions with another of another label, by component.  A cluster's name is a hash of its members."""
    for table in whole_groups(batches, "node"):
        node, ids, label = table["node"].to_numpy(), table["id"].to_numpy(), table["label"].to_numpy()
        mh = table["mh"].combine_chunks()
        mh = (mh.chunk(0) if isinstance(mh, pa.ChunkedArray) else mh).flatten().to_numpy().reshape(len(ids), POSITIONS)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(first, append=len(node))
        members: list[np.ndarray] = []
        pairs = first[size == 2]
        if len(pairs):
            good = pairs[(mh[pairs] == mh[pairs + 1]).sum(axis=1) >= agree]
            good = good[label[good] != label[good + 1]]
            members += list(np.stack((good, good + 1), axis=1))
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = mh[a : a + n]
            near = np.zeros((n, n), np.uint8)
            for k in range(POSITIONS):
                near += own[:, k, None] == own[None, :, k]
            root = roots_of((near >= agree) & (label[a : a + n, None] != label[None, a : a + n]))
            members += [a + np.flatnonzero(root == r) for r in np.flatnonzero(np.bincount(root) > 1)]
        if members:
            flat = np.concatenate(members)
            sizes = np.array([len(m) for m in members])
            at = np.cumsum(sizes) - sizes
            name = np.add.reduceat(mix(ids[flat].view(np.uint64) + np.uint64(77)), at)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mix(name), sizes).view(np.int64)), pa.array(ids[flat], pa.int64())], names=["cluster", "id"])


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of 0/1 matrices, a block of shingles at a time."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), np.float64)
    width = max(1, (1 << 22) // n)
    for a in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        x = np.zeros((n, width), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        out += x @ x.T
    return out


def linked_pairs(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, percent: int, entries: int = 1 << 22) -> np.ndarray:
    """Those a for which the sets a and a + 1 link: all pairs are sorted at once, some `entries` shingles at a time."""
    least, most = np.minimum(size[a], size[a + 1]), np.maximum(size[a], size[a + 1])
    a = a[100 * least >= percent * most]
    stop = np.cumsum(size[a] + size[a + 1])
    found, k, done = [a[:0]], 0, 0
    while k < len(a):
        end = max(k + 1, int(np.searchsorted(stop, done + entries, side="right")))
        own = a[k:end]
        total = size[own] + size[own + 1]
        flat, pair = np.concatenate([sets[i] for j in own.tolist() for i in (j, j + 1)]), np.repeat(np.arange(len(own)), total)
        order = np.lexsort((flat, pair))
        flat, pair = flat[order], pair[order]
        both = np.bincount(pair[1:][(flat[1:] == flat[:-1]) & (pair[1:] == pair[:-1])], minlength=len(own))
        found.append(own[100 * both >= percent * (total - both)])
        k, done = end, int(stop[end - 1])
    return np.concatenate(found)


def exact_links(batches, percent: int):
    """mapInArrow over rows sorted by cluster: (cluster, id, set) to links (u, v): for each component of a cluster
    its smallest id with each other one."""
    for table in whole_groups(batches, "cluster"):
        cluster, ids = table["cluster"].to_numpy(), table["id"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table["set"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        first = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
        members = np.diff(first, append=len(ids))
        pairs = linked_pairs(sets, sizes, first[members == 2], percent)
        u, v = np.minimum(ids[pairs], ids[pairs + 1]).tolist(), np.maximum(ids[pairs], ids[pairs + 1]).tolist()
        for a, n in zip(first[members > 2].tolist(), members[members > 2].tolist(), strict=True):
            b, size = a + n, sizes[a : a + n]
            both = common(sets[a:b])
            root = roots_of(100 * both >= percent * (size[:, None] + size[None, :] - both))
            for r in np.flatnonzero(np.bincount(root) > 1):
                member = np.sort(ids[a:b][root == r])
                u += [int(member[0])] * (len(member) - 1)
                v += member[1:].tolist()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame, folder: str) -> DataFrame:
    """(id, component): the smallest id that each linked id can reach, by alternating large and small stars.  A star
    turns each edge into one edge, so their number never grows."""
    edges = stash(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), folder, "star0")
    n, k = edges.count(), 0
    while not all_stars(edges):
        k += 1
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(near(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stash(large, folder, f"large{k}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # an id's edge to its least one stays, its others lead from there
        small = large.join(near(least, n), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stash(small if n <= FEW else small.distinct(), folder, f"star{k}")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def all_stars(edges: DataFrame) -> bool:
    """Whether every id has one centre, and no centre has one itself: then all components are found.  Edges may repeat."""
    seen = edges.select(F.col("u").alias("x"), F.col("v").alias("of"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(None), F.lit(1)))
    bad = seen.groupBy("x").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.max("centre").alias("centre")).where("low <> high or low is not null and centre > 0")
    return bad.isEmpty()


def branch(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, id, mh, was) to the children (node, id, was); `was` is the number of the node's members.

    A node has floor(1 / threshold) children, and one more with the probability of what is left; each child has its own
    position.  All members of a node choose alike, by hashes of the node's name.
    """
    mean = 1 / threshold
    chance = F.pmod(F.xxhash64("node", F.lit(99)), F.lit(1_000_000)) / 1_000_000
    n = F.lit(math.floor(mean)) + F.when(chance < mean - math.floor(mean), 1).otherwise(0)
    child = rows.select("node", "id", "mh", "was", F.explode(F.sequence(F.lit(1), n)).alias("c"))
    token = F.element_at("mh", F.pmod(F.xxhash64("node", "c", F.lit(1)), F.lit(POSITIONS)).cast("int") + 1)
    return child.select(F.xxhash64("node", "c", F.array(token)).alias("node"), "id", "was")


def parted(threshold: float, depth: int, agree: float) -> float:
    """The chance that one tree has parted, after `depth` levels, a pair that agrees in a share `agree` of positions."""
    mean, q = 1 / threshold, 0.0
    more = mean - math.floor(mean)
    for _ in range(depth):
        lost = 1 - agree + agree * q
        q = lost ** math.floor(mean) * (1 - more + more * lost)
    return q


def tree_count(recall: float, threshold: float, depth: int) -> int:
    """Fewest trees that keep a pair at the threshold together in one of them with a chance of `recall`, over what the
    positions of such a pair may agree in: all trees draw from the same positions."""
    k = np.arange(POSITIONS + 1)
    ways = np.array([math.comb(POSITIONS, int(j)) for j in k], float)
    weight = ways * threshold**k * (1 - threshold) ** (POSITIONS - k)
    lost = np.array([parted(threshold, depth, j / POSITIONS) for j in k])
    return next(n for n in range(1, 1000) if (weight * lost**n).sum() <= 1 - recall or n == 999)


def sized(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, id, n): nodes of n > 1 members."""
    counts = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    return stash(nodes.join(counts, "node"), folder, name)


def crowd_blocks(crowded: DataFrame, small: int, total: int) -> DataFrame:
    """(cluster, id): members in blocks of a quarter of `small`, each with the pivots of its node; a member goes with
    its largest node only.  And pivots of all nodes, by the nodes that they are in.  `total` is the number of rows of
    crowded."""
    own = crowded.groupBy("id").agg(F.max(F.struct("n", "node")).alias("o")).select("id", "o.node", F.ceil(F.col("o.n") * 4 / small).alias("blocks"))
    name = lambda b: F.xxhash64("node", b).alias("cluster")
    first = own.groupBy("node", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(F.xxhash64("id", F.lit(7)), "id")).alias("p"), F.max("blocks").alias("blocks"))
    pivots = first.select("node", F.col("p.id").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    slot = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(MEETING))
    together = crowded.join(near(first.select("p.id").distinct(), total), "id").groupBy(F.col("node").alias("cluster"), slot.alias("slot")).agg(F.min("id").alias("id"))
    return own.select(name(F.pmod(F.xxhash64("id"), F.col("blocks"))), "id").union(pivots.select(name(F.col("b")), "id")).union(together.select("cluster", "id")).distinct()


def set_chunks(batches, entries: int = 1 << 22):
    """(rows, shingles, bounds) of batches with a column `set`, some `entries` shingles (or one set) at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("set"))
        size = np.asarray(pa.compute.binary_length(column)).astype(np.int64) // 8
        a = 0
        while a < len(size):
            total = np.cumsum(size[a:])
            b = a + max(1, int(np.searchsorted(total, entries, side="right")))
            part = batch.slice(a, b - a)
            yield part, np.frombuffer(b"".join(part.column("set").to_pylist()), np.uint64), np.concatenate(([0], total[: b - a]))
            a = b


def count_shingles(batches):
    """mapInArrow: (id, set) to (shingle, c)."""
    for _, flat, _ in set_chunks(batches):
        value, c = np.unique(flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(c, pa.int64())], names=["shingle", "c"])


def frequent_shingles(sets: DataFrame, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the logarithms of their frequencies: whole classes of these, as many as
    FREQUENT shingles allow."""
    counts = sets.select("id", "set").mapInArrow(count_shingles, "shingle long, c long").groupBy("shingle").agg(F.floor(F.log2(F.sum("c"))).cast("int").alias("level"))
    counts = stash(counts.where("level > 0"), folder, "crowd_counts")
    total, least = 0, 64
    for level, n in sorted(map(tuple, counts.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = level
    top = counts.where(F.col("level") >= least).toArrow()
    shingle, level = top["shingle"].to_numpy().view(np.uint64), top["level"].to_numpy().astype(np.int8)
    order = np.argsort(shingle)
    return shingle[order], level[order]


def prefixes(batches, percent: int, shingle: np.ndarray, level: np.ndarray):
    """mapInArrow: (id, label, set) to (shingle, id, label, n, pos, entry): the rarest shingles of each set that a link
    needs one of; entries are those that a larger set looks up."""
    for part, flat, bounds in set_chunks(batches):
        n = np.diff(bounds)
        doc = np.repeat(np.arange(len(n)), n)
        rank = np.zeros(len(flat), np.int8)
        if len(shingle):
            at = np.minimum(np.searchsorted(shingle, flat), len(shingle) - 1)
            rank = np.where(shingle[at] == flat, level[at], 0)
        order = np.lexsort((flat, rank, doc))
        pos = np.arange(len(flat)) - bounds[doc]
        take = np.flatnonzero(pos < (n + 1 + (-percent * n) // 100)[doc])
        doc, pos = doc[take], pos[take]
        entry = pos < (n + 1 + (-2 * percent * n) // (100 + percent))[doc]
        of = pa.array(doc)
        yield pa.RecordBatch.from_arrays([pa.array(flat[order][take].view(np.int64)), part.column("id").take(of), part.column("label").take(of), pa.array(n[doc], pa.int64()), pa.array(pos, pa.int64()), pa.array(entry)], names=["shingle", "id", "label", "n", "pos", "entry"])


def prefix_nodes(rows: DataFrame, small: int) -> DataFrame:
    """(node, id, label, n, pos, entry): entries of a shingle and its other rows, in pairs of blocks of a quarter of
    `small`.  Shingles without entries, and those whose members are linked already, are left out."""
    blocks = lambda c: F.ceil(c * 4 / small)
    counts = rows.groupBy("shingle").agg(F.count_if("entry").alias("e"), F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"))
    counts = counts.where("e > 0 and low <> high").select("shingle", blocks(F.col("e")).alias("e"), blocks(F.col("c")).alias("c"))
    both = rows.join(near(counts, rows.count() // 2), "shingle")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias("b")
    rest = ["id", "label", "n", "pos"]
    entries = both.where("entry").select("shingle", *rest, own("e").alias("a"), every("c")).select(F.xxhash64("shingle", "a", "b").alias("node"), *rest, F.lit(True).alias("entry"))
    looked = both.select("shingle", *rest, own("c").alias("a"), every("e")).select(F.xxhash64("shingle", "b", "a").alias("node"), *rest, F.lit(False).alias("entry"))
    return entries.union(looked)


def prefix_pairs(batches, percent: int, agree: int):
    """mapInArrow over rows sorted by node: (node, id, label, n, pos, entry, mh) to pairs (u, v) of different labels
    whose sizes and positions admit a link and that agree in `agree` minhashes."""
    for table in whole_groups(batches, "node"):
        node, ids, label, n, pos, entry = (table[c].to_numpy(zero_copy_only=False) for c in ("node", "id", "label", "n", "pos", "entry"))
        mh = table["mh"].combine_chunks()
        mh = (mh.chunk(0) if isinstance(mh, pa.ChunkedArray) else mh).flatten().to_numpy().reshape(len(ids), POSITIONS)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        size = np.diff(first, append=len(node))
        group = np.repeat(np.arange(len(first)), size)
        small = np.flatnonzero(entry)
        stop = np.cumsum(size[group[small]])
        a, done = 0, 0
        while a < len(small):  # a million pairs at a time
            b = max(a + 1, int(np.searchsorted(stop, done + (1 << 20), side="right")))
            count = size[group[small[a:b]]]
            x, y = np.repeat(small[a:b], count), ranges(first[group[small[a:b]]], count)
            a, done = b, int(stop[b - 1])
            least = np.minimum(n[x] - pos[x], n[y] - pos[y])
            good = ~entry[y] & (label[x] != label[y]) & (n[x] <= n[y]) & (100 * n[x] >= percent * n[y]) & ((100 + percent) * least >= percent * (n[x] + n[y]))
            x, y = x[good], y[good]
            good = np.concatenate([(mh[x[k : k + 65536]] == mh[y[k : k + 65536]]).sum(axis=1) >= agree for k in range(0, len(x), 65536)] or [np.zeros(0, bool)])
            u, v = np.minimum(ids[x], ids[y])[good], np.maximum(ids[x], ids[y])[good]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def crowd_clusters(crowded: DataFrame, total: int, reps: DataFrame, folder: str, percent: int, small: int, agree: int, sets_of, compare) -> tuple[DataFrame, DataFrame]:
    """(cluster, id), pairs of members of crowds to be compared exactly, and the links within blocks.  `total` is the
    number of rows of crowded."""
    sets = stash(sets_of(crowded, total, folder), folder, "crowd_sets")
    blocks, most = crowd_blocks(crowded, small, total), total * (2 + 128 // small)
    links = compare(blocks if most <= FEW else stash(blocks, folder, "crowd_blocks"), most, f"{folder}/crowd", sets)
    labels = components(links, f"{folder}/crowd").withColumnRenamed("component", "label")
    labelled = sets.join(near(labels, links.count()), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "set")
    shingle, level = frequent_shingles(sets, folder)
    rows = labelled.mapInArrow(lambda it: prefixes(it, percent, shingle, level), "shingle long, id long, label long, n long, pos long, entry boolean")
    nodes = stash(prefix_nodes(stash(rows, folder, "crowd_prefixes"), small), folder, "crowd_nodes")
    pairs = reps.join(near(nodes, nodes.count()), "id").repartition("node").sortWithinPartitions("node").mapInArrow(lambda it: prefix_pairs(it, percent, agree), "u long, v long").distinct()
    return pairs.select(F.xxhash64("u", "v").alias("cluster"), F.explode(F.array("u", "v")).alias("id")), links


def find_clusters(reps: DataFrame, folder: str, percent: int, recall: float, small: int, max_depth: int, agree: int, sets_of, compare) -> tuple[DataFrame, DataFrame | None]:
    """(cluster, id), groups of representatives that look alike and are to be compared exactly; and links that crowds
    have given already.  sets_of(ids, number of ids, folder) gives full sets, compare(clusters, their number of rows,
    folder, sets) the exact links within clusters."""
    threshold = percent / 100
    roots = F.sequence(F.lit(1).cast("long"), F.lit(tree_count(recall, threshold, max_depth)).cast("long"))
    rows = reps.select("id", "mh", F.explode(roots).alias("node"), F.lit(None).cast("long").alias("was"))
    found, crowded = [], []
    for depth in range(1, max_depth + 1):
        nodes = sized(branch(rows, threshold), folder, f"nodes{depth}")
        found.append(nodes.where(F.col("n") <= small).select("node", "id"))
        grows = F.coalesce(F.col("n") > threshold * F.col("was"), F.lit(False)) | F.lit(depth == max_depth)
        large = nodes.where(F.col("n") > small)
        crowded.append(large.where(grows).select("node", "id", "n"))
        again = large.where(~grows)
        n = again.count()
        if not n:
            break
        again = again.groupBy("id").agg(F.collect_list(F.struct("node", F.col("n").alias("was"))).alias("at"))  # a few per tree
        rows = reps.join(near(again, n), "id").select("id", "mh", F.inline("at"))
    found, crowded = functools.reduce(DataFrame.union, found), functools.reduce(DataFrame.union, crowded)
    members = found.withColumn("label", F.col("id")).join(reps, "id").select("node", "id", "label", "mh").repartition("node").sortWithinPartitions("node")
    clusters, links = members.mapInArrow(lambda it: sketch_clusters(it, agree), "cluster long, id long").distinct(), None
    total = crowded.count()
    if total:
        pairs, links = crowd_clusters(crowded, total, reps, folder, percent, small, agree, sets_of, compare)
        clusters = clusters.union(pairs)
    return stash(clusters, folder, "clusters"), links


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 85, recall: float = 0.9999, small: int = 1024, max_depth: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_shingles, component_id (the smallest id reachable by links, itself included) and kept.

    Sets link if 100 * intersection >= percent * union.  Null texts and texts without words have no shingles and link
    with nothing.  Texts of fewer words than a shingle are one shingle.  Equal sets are linked, however many there are.
    Rows that repeat an id are one document listed again.  A null id counts as smaller than all others.
    Columns of docs keep their names; input columns named like a result column are replaced.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    docs = docs.drop(*RESULT)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    signs = stash(texts.mapInArrow(lambda it: sign(it, shingle), SIGNATURE), folder, "signatures")
    same = ["s1", "s2", "n_shingles"]
    reps = signs.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("id", "mh")).alias("r"))
    reps = stash(reps.select(*same, F.col("r.id").alias("id"), F.col("r.mh").alias("mh")), folder, "representatives")
    agree = max(1, math.floor(POSITIONS * percent / 100 - 5 * math.sqrt(POSITIONS * percent / 100 * (1 - percent / 100))))

    def sets_of(ids: DataFrame, n: int, to: str) -> DataFrame:
        wanted = ids.select("id").distinct()
        wanted = near(wanted, n) if n <= FEW else small_side(stash(wanted, to, "wanted"))
        return texts.join(wanted, "id", "left_semi").mapInArrow(lambda it: full_sets(it, shingle), "id long, set binary").dropDuplicates(["id"])

    def compare(clusters: DataFrame, n: int, to: str, sets: DataFrame | None = None) -> DataFrame:
        sets = sets_of(clusters, n, to) if sets is None else sets
        rows = sets.join(near(clusters, n), "id").select("cluster", "id", "set").repartition("cluster").sortWithinPartitions("cluster")
        return stash(rows.mapInArrow(lambda it: exact_links(it, percent), "u long, v long"), to, "links")

    clusters, crowd_links = find_clusters(reps.select("id", "mh"), folder, percent, recall, small, max_depth, agree, sets_of, compare)
    links = compare(clusters, clusters.count(), folder)
    links = links if crowd_links is None else links.union(crowd_links)
    n_links = links.count()
    release(spark)
    reached = components(links, folder)
    forget(spark, *[f"{folder}/{name}" for name in (*(f"nodes{k}" for k in range(1, max_depth + 1)), "crowd_sets", "crowd_counts", "crowd_blocks", "crowd_prefixes", "crowd_nodes", "clusters", "wanted", "links", "crowd")])
    of_set = reps.select(*same, "id").join(near(reached, n_links), "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    verdict = signs.select("id", *same).distinct().join(of_set, same, "left")
    real = lambda c: F.when(c != NO_ID, c)
    verdict = verdict.select("id", "n_shingles", real(F.coalesce("component", "id")).alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept"))
    (key,) = fresh(docs, "key")
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    return rows.join(verdict.withColumnRenamed("id", key), key).select(*docs.columns, *RESULT)


def op8(spark, sf_dir: str) -> DataFrame:
    """op8_minhash_dedup: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", *RESULT)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 85 * (x.n + y.n - c)),
o AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
r(id, root) AS (SELECT DISTINCT i, i FROM o UNION SELECT o.j, r.root FROM r JOIN o ON o.i = r.id),
m AS (SELECT id, min(root) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""


def brute_force(docs: list[tuple], shingle: int = 5, percent: int = 85) -> list[tuple]:
    """The contract over all pairs, for small inputs: (doc_id, n_shingles, component_id, kept)."""
    sets = {}
    for i, t in docs:
        data = (t or "").encode()
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in data).split()
        sets[i] = {tuple(w[p : p + shingle]) for p in range(max(1, len(w) - shingle + 1))} if w else set()
    at: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared: dict[int, int] = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in sets.items()]
