"""Exact joins of vectors by cells around pivots: k nearest neighbours, and all pairs above a threshold.

Vectors belong to the cell of their nearest pivot.  A cell knows how near and how far from its pivot its vectors are, so
the triangle inequality bounds the distance of any vector to all of a cell, and a vector only travels to cells that may
hold something near enough.  Cells may be of any size: what comes to visit a cell is dealt into blocks that fit into
memory, and the vectors of the cell stream past each of them, in several tasks where they are many.  The driver holds
pivots and three numbers a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import cluster
from lumenfold.operators import vectors as V
from lumenfold.sources.tables import forget, working_folder, written

#: The most cells; rows of a block of visitors, and bytes of its vectors; rows that stream past it in one task.
MOST_CELLS, VISITORS, BLOCK_BYTES, STREAM = 1_024, 8_192, 16 << 20, 1 << 20
#: Vectors that pivots are fitted on, at most, and those of them that the number of cells is chosen by.
SAMPLE, TRIED = 8_192, 1_000
#: Seconds to send a vector to a block, and to measure a pair: only their ratio matters, for the number of cells.
SEND, MEASURE = 1e-5, 3e-8
#: What bounds must miss by before they rule a cell out, as a share of the extent of all cells: roundings are far below it.
SLACK = 1e-6
#: Pivots nearer to each other than this share of that extent part nothing by the plane between them.
APART = 1e-3


def points(v: np.ndarray, metric: str, kind: int = 0) -> np.ndarray:
    """Rows as points whose Euclidean distances are ordered as the metric's.  For cosines these are unit vectors; as
    a zero vector has cosine 0 with everything, it gets a direction of its own (another one for each kind)."""
    if metric != "cosine":
        return v
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    extra = np.zeros((len(v), 2))
    extra[norm[:, 0] == 0, kind] = 1
    return np.hstack((v / np.where(norm > 0, norm, 1), extra))


def reach(d: np.ndarray | float, metric: str):
    """Distances of points from what V.measured() gives: squared distances, or negative cosines."""
    return np.sqrt(np.maximum(2 + 2 * d if metric == "cosine" else d, 0))


def distances_in_pieces(x: np.ndarray, pivots: np.ndarray, step: int | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """Parts of the rows of x with their distances from all pivots.  All are moved so that the pivots' mean is the origin:
    the error of products grows with the norms."""
    step, middle = step or max(1, V.CELLS // max(1, len(pivots))), pivots.mean(axis=0)
    for a in range(0, len(x), step):
        yield slice(a, a + step), np.sqrt(V.distances(x[a : a + step] - middle, pivots - middle, "l2"))


@dataclass(frozen=True)
class Cells:
    """Pivots, and of each cell the least and the largest distance from its pivot and the number of vectors."""

    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    between: np.ndarray
    extent: float

    @classmethod
    def of(cls, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> Cells:
        between = next(d for _, d in distances_in_pieces(pivots, pivots, len(pivots)))
        return cls(pivots, low, high, sizes, between, float(between.max() + max(0.0, high.max())))

    def pieces(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        return distances_in_pieces(x, self.pivots)

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """The least distance that rows may have from anything in a cell, by their distances d from the pivots."""
        home = d.argmin(axis=1)
        # what is nearer to its own pivot than to ours lies behind the plane between both
        apart = self.between[home]
        plane = (d**2 - np.take_along_axis(d, home[:, None], 1) ** 2) / (2 * np.maximum(apart, APART * self.extent + 1e-300))
        out = np.maximum(np.maximum(d - self.high, self.low - d), np.where(apart > APART * self.extent, plane, 0)) - SLACK * self.extent
        out[:, self.sizes == 0] = np.inf
        return out


def nearest_pivot(vectors: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """vectors (id, v) plus cell and dist, the nearest pivot and how far it is."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, dist double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        out = [(d.argmin(axis=1), d.min(axis=1)) for _, d in distances_in_pieces(points(V.stack(v), metric), shared.value)]
        return pd.DataFrame({"cell": np.concatenate([c for c, _ in out]).astype(np.int32), "dist": np.concatenate([d for _, d in out])})

    return vectors.withColumn("__home", nearest("v")).select(*vectors.columns, F.col("__home.cell").alias("cell"), F.col("__home.dist").alias("dist"))


def chosen_pivots(x: np.ndarray, n: int, within: float | None, k: int) -> np.ndarray:
    """The pivots, of several numbers of them, that promise the least work for n vectors, by what a part of the sample x
    would visit.  Small cells rule out more, but a vector is sent to each cell that it visits; where nothing can be ruled
    out, as in random directions of many dimensions, few cells are best."""
    best, least, m = x[:1], math.inf, 1
    probe = x[:: max(1, len(x) // TRIED)][:TRIED]
    if within is None:  # the k-th distance within the sample is above that within all
        d = np.sqrt(V.distances(probe, x, "l2"))
        within = np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, min(k, d.shape[1] - 1), None]
    while m <= min(MOST_CELLS, max(1, len(x) // 4)):
        pivots = V.centres_of(x, m, iterations=4)
        parts = [(d.argmin(axis=1), d.min(axis=1)) for _, d in distances_in_pieces(x, pivots)]
        own, near = np.concatenate([c for c, _ in parts]), np.concatenate([d for _, d in parts])
        low, high = np.full(m, np.inf), np.full(m, -np.inf)
        np.minimum.at(low, own, near)
        np.maximum.at(high, own, near)
        sizes = np.bincount(own, minlength=m)
        cells = Cells.of(pivots, low, high, sizes)
        visited = cells.bounds(next(d for _, d in distances_in_pieces(probe, pivots, len(probe)))) <= within
        share, pairs = sizes / len(x), (visited * n * sizes / len(x)).sum(axis=1).mean()
        sent = (visited * np.ceil(n * share / STREAM)).sum(axis=1).mean() + (share * np.ceil(n * visited.mean(axis=0) / VISITORS)).sum()
        cost = sent * SEND + pairs * MEASURE
        if cost < least:
            best, least = pivots, cost
        m *= 4
    return best


def dealt(vectors: DataFrame, metric: str, path: str, n_cells: int | None, within: float | None, k: int = 1) -> tuple[DataFrame, Cells]:
    """vectors (id, v) with cell and dist, written; and the cells.  Pivots are centres of k-means over SAMPLE vectors at
    most, and chosen for distances `within` or the k-th; any pivots give the same results."""
    x = points(V.sampled(vectors, "v", SAMPLE), metric)
    pivots = np.zeros((1, 1)) if not len(x) else V.centres_of(x, n_cells) if n_cells else chosen_pivots(x, vectors.count(), within, k)
    homed = written(nearest_pivot(vectors, pivots, metric), path)
    stats = homed.groupBy("cell").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).toPandas()  # a row for each pivot
    low, high, sizes = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    low[stats["cell"]], high[stats["cell"]], sizes[stats["cell"]] = stats["low"], stats["high"], stats["n"]
    return homed, Cells.of(pivots, low, high, sizes)


def meet(visitors: DataFrame, homed: DataFrame, cells: Cells, work: Callable[[pd.DataFrame], Work], schema: str, folder: str, name: str) -> tuple[DataFrame, int]:
    """What work(block of visitors) makes of the vectors of their cell, and how many pairs of rows meet.  visitors have id,
    v and cell; both may have home and n.  A task holds a block of visitors and one batch of the cell."""
    visitors = written(visitors, f"{folder}/{name}")
    counts = visitors.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each pivot
    spark = homed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    total = sum(r["n"] for r in counts)
    most = max(1, min(VISITORS, BLOCK_BYTES // (8 * cells.pivots.shape[1]), max(500, total // (4 * cores))))
    table, groups = [], 0
    for r in counts:
        blocks, streams = -(-r["n"] // most), -(-int(cells.sizes[r["cell"]]) // STREAM)
        if streams:
            table.append((r["cell"], blocks, streams, groups))
            groups += blocks * streams
    grid = F.broadcast(spark.createDataFrame(table, "cell int, blocks long, streams long, first long"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def side(rows: DataFrame, tag: int, block, stream) -> DataFrame:
        more = [(F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c) for c in ("home", "n")]
        placed = rows.join(grid, "cell").withColumn("block", block).withColumn("stream", stream)
        return placed.select((F.col("first") + F.col("block") * F.col("streams") + F.col("stream")).alias("g"), F.lit(tag).alias("tag"), "id", "v", "cell", *more)

    both = side(visitors, 0, own("blocks"), every("streams")).unionByName(side(homed, 1, every("blocks"), own("streams")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, at_work = None, [], None
        for batch in batches:
            turns = np.flatnonzero(np.diff(batch["g"] * 2 + batch["tag"])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)], strict=True):
                piece = batch.iloc[a:b]
                if not len(piece):
                    continue
                if piece["g"].iloc[0] != group:
                    if at_work:
                        yield from at_work.end()
                    group, held, at_work = piece["g"].iloc[0], [], None
                if piece["tag"].iloc[0] == 0:
                    held.append(piece)
                elif held:
                    at_work = at_work or work(pd.concat(held, ignore_index=True))
                    yield from at_work.feed(piece)
        if at_work:
            yield from at_work.end()

    parts = max(1, min(groups, 64 * cores))
    dealt_out = both.repartitionById(parts, F.pmod("g", F.lit(parts)).cast("int"))
    return dealt_out.sortWithinPartitions("g", "tag").mapInPandas(run, schema), sum(r["n"] * int(cells.sizes[r["cell"]]) for r in counts)


class Work:
    """What a block of visitors makes of the vectors that stream past it."""

    def __init__(self, visitors: pd.DataFrame):
        self.visitors, self.points = visitors, V.stack(visitors["v"])

    def feed(self, some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def end(self) -> Iterator[pd.DataFrame]:
        return iter(())


class Nearest(Work):
    """Keeps the k nearest of each visitor: (query_id, id, d)."""

    def __init__(self, visitors: pd.DataFrame, k: int, metric: str):
        super().__init__(visitors)
        self.k, self.metric = k, metric
        self.ids, self.d = np.zeros((len(visitors), 0), np.int64), np.zeros((len(visitors), 0))

    def feed(self, some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids, d = V.nearest(self.points, V.stack(some["v"]), some["id"].to_numpy(np.int64), self.k, self.metric)
        ids, d = np.hstack((self.ids, ids)), np.hstack((self.d, d))
        order = np.lexsort((ids, d), axis=1)[:, : self.k]
        self.ids, self.d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"query_id": np.repeat(self.visitors["id"].to_numpy(np.int64), self.ids.shape[1]), "id": self.ids.ravel(), "d": self.d.ravel()})


class Similar(Work):
    """Finds what is similar enough: hits(rows of visitors, rows of `some`, scores)."""

    def __init__(self, visitors: pd.DataFrame, threshold: float, metric: str):
        super().__init__(visitors)
        self.threshold, self.metric = threshold, metric

    def hits(self, some: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        other, step = V.stack(some["v"]), max(1, V.CELLS // len(some))
        for a in range(0, len(self.points), step):
            scores = V.similarities(self.points[a : a + step], other, self.metric)
            x, y = np.nonzero(scores >= self.threshold)
            yield x + a, y, scores[x, y]


class Pairs(Similar):
    """(i, j, similarity), each pair once: within a cell from the smaller id's side."""

    def feed(self, some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for x, y, scores in self.hits(some):
            i, j = self.visitors["id"].to_numpy(np.int64)[x], some["id"].to_numpy(np.int64)[y]
            once = np.where(self.visitors["home"].to_numpy()[x] == some["cell"].to_numpy()[y], i < j, i != j)
            yield pd.DataFrame({"i": np.minimum(i, j)[once], "j": np.maximum(i, j)[once], "similarity": scores[once]})


class Counts(Similar):
    """(rep, links): how many ids each visitor is similar to, itself excluded."""

    def __init__(self, visitors: pd.DataFrame, threshold: float, metric: str):
        super().__init__(visitors, threshold, metric)
        self.links = np.zeros(len(visitors))

    def feed(self, some: pd.DataFrame) -> Iterator[pd.DataFrame]:
        weights = some["n"].to_numpy()
        for x, y, _ in self.hits(some):
            other = self.visitors["id"].to_numpy(np.int64)[x] != some["id"].to_numpy(np.int64)[y]
            self.links += np.bincount(x[other], weights=weights[y[other]], minlength=len(self.links))
        return iter(())

    def end(self) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"rep": self.visitors["id"].to_numpy(np.int64), "links": self.links.astype(np.int64)})


# ---- nearest neighbours

def knn_cells(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector: str = "embedding", metric: str = "l2", n_cells: int | None = None, measured: list[int] | None = None) -> DataFrame:
    """(query_id, rank, id, similarity): the rows of V.knn_join() for any number of queries, none of which reaches the
    driver.

    First a query looks into the nearest cells that have k vectors together; what it finds bounds its k-th distance,
    and then it visits the other cells that may still hold something as near.  Of equal vectors only the k with the
    smallest ids can be neighbours, so copies beyond them stay out.  Query ids must be unique.  Null vectors are left
    out; without vectors or queries there are no rows.  The pairs that were measured are added to `measured`.
    """
    spark, folder = vectors.sparkSession, working_folder(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null")
    copies = Window.partitionBy("v").orderBy("id")
    rows = written(rows.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k).drop("__copy"), f"{folder}/vectors")
    homed, cells = dealt(rows, metric, f"{folder}/homed", n_cells, None, k)
    wanted = written(queries.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null"), f"{folder}/queries")
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def start(v: pd.Series) -> pd.Series:
        """The nearest cells, as many as it takes to have k vectors."""
        out = []
        for _, d in shared.value.pieces(points(V.stack(v), metric, 1)):
            order = np.argsort(d, axis=1, kind="stable")
            n = np.minimum((np.cumsum(shared.value.sizes[order], axis=1) < k).sum(axis=1) + 1, d.shape[1])
            out += [o[:m].astype(np.int32) for o, m in zip(order, n, strict=True)]
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, furthest: pd.Series, started: pd.Series) -> pd.Series:
        """Cells not visited yet whose bound does not exceed the k-th distance (all where there is none)."""
        out, far = [], reach(furthest.to_numpy(dtype=np.float64, na_value=np.inf), metric)
        for at, d in shared.value.pieces(points(V.stack(v), metric, 1)):
            near = (shared.value.bounds(d) <= far[at][:, None]) & (shared.value.sizes > 0)
            for row, done in zip(near, started[at], strict=True):
                row[done] = False
                out.append(np.flatnonzero(row).astype(np.int32))
        return pd.Series(out)

    def search(q: pd.DataFrame) -> Work:
        return Nearest(q, k, metric)

    schema = "query_id long, id long, d double"
    wanted = written(wanted.withColumn("started", start("v")), f"{folder}/started")
    found, n = meet(wanted.select("id", "v", F.explode("started").alias("cell")), homed, cells, search, schema, folder, "start")
    found = written(found, f"{folder}/found")
    best = V.ranked(found, k).groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("d"))).alias("kth"))
    bounded = wanted.join(best, F.col("id") == F.col("query_id"), "left").drop("query_id")
    more, m = meet(bounded.select("id", "v", F.explode(others("v", "kth", "started")).alias("cell")), homed, cells, search, schema, folder, "others")
    if measured is not None:
        measured.append(n + m)
    return V.scored(V.ranked(found.unionByName(more), k), metric)


# ---- pairs above a threshold

def distance_of(threshold: float, metric: str) -> float:
    """The largest distance of points whose similarity reaches the threshold."""
    if metric == "cosine":
        return math.sqrt(max(0.0, 2 - 2 * threshold))
    return math.sqrt(max(0.0, 1 / threshold - 1)) if threshold > 0 else math.inf


def _self_join(vectors: DataFrame, threshold: float, id_col: str, vector: str, metric: str, n_cells: int | None, measured: list[int] | None, work, schema: str, *, once: bool) -> tuple[DataFrame, DataFrame]:
    """What `work` makes of all vectors that may be similar, and the members of classes.  A vector visits those cells whose
    bound is within the threshold's distance; with `once`, of two cells that would visit each other one does."""
    spark, folder = vectors.sparkSession, working_folder(vectors.sparkSession)
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where("v is not null")
    rows = written(given.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "v", "n"), f"{folder}/classes")
    within = distance_of(threshold, metric)
    homed, cells = dealt(rows, metric, f"{folder}/homed", n_cells, within)
    shared = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("array<int>")
    def visits(v: pd.Series, home: pd.Series) -> pd.Series:
        out, home = [], home.to_numpy()
        for at, d in shared.value.pieces(points(V.stack(v), metric)):
            own, others = home[at][:, None], np.arange(d.shape[1])[None, :]
            # the cell with the smaller number visits if both numbers are odd or both even
            mine = np.where((own + others) % 2 == 0, own < others, own > others) | (own == others)
            near = (mine if once else True) & (shared.value.bounds(d) <= within)
            near[np.arange(len(near)), home[at]] = True
            out += [np.flatnonzero(row).astype(np.int32) for row in near]
        return pd.Series(out)

    visitors = homed.withColumn("home", F.col("cell")).withColumn("cell", F.explode(visits("v", "home"))).drop("dist")
    found, n = meet(visitors, homed, cells, work, schema, folder, "visitors")
    if measured is not None:
        measured.append(n)
    zero = F.aggregate(F.transform("v", lambda x: F.abs(x).cast("double")), F.lit(0.0), lambda a, x: a + x) == 0
    own = (~zero if threshold > 0 else F.lit(True)) if metric == "cosine" else F.lit(True)
    members = given.join(rows.select(F.col("id").alias("rep"), F.col("v").alias("of"), "n"), F.col("v") == F.col("of")).select("rep", "id", "n", (F.lit(threshold <= 1) & own).alias("own"))
    return found, written(members, f"{folder}/members")


def similar_classes(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vector: str = "embedding", metric: str = "cosine", n_cells: int | None = None, measured: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of different vectors whose similarity reaches the threshold, (i, j, similarity) by the least ids i < j
    of equal vectors; and (rep, id, n, own): every id with the least id of its vector, how many have it, and whether
    equal vectors are similar.

    Null vectors are left out.  The pairs that were measured are added to `measured`.
    """

    found, members = _self_join(vectors, threshold, id_col, vector, metric, n_cells, measured, lambda q: Pairs(q, threshold, metric), "i long, j long, similarity double", once=True)
    return written(found, f"{working_folder(vectors.sparkSession)}/pairs"), members


def link_counts(vectors: DataFrame, threshold: float, *, id_col: str = "vec_id", vector: str = "embedding", metric: str = "cosine", n_cells: int | None = None) -> DataFrame:
    """(id, n_links): for every id with a vector, how many others are similar.  Every vector counts what it meets,
    so no pairs are made; copies count by class."""

    found, members = _self_join(vectors, threshold, id_col, vector, metric, n_cells, None, lambda q: Counts(q, threshold, metric), "rep long, links long", once=False)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    total = F.coalesce("links", F.lit(0)) + F.when(F.col("own"), F.col("n") - 1).otherwise(0)
    return members.join(linked, "rep", "left").select("id", total.alias("n_links"))


def expanded(pairs: DataFrame, members: DataFrame, metric: str = "cosine") -> DataFrame:
    """(i, j, similarity) of ids, i < j, from similar_classes(): as many rows as there are pairs."""
    a, b = members.select(F.col("rep").alias("i"), F.col("id").alias("x")), members.select(F.col("rep").alias("j"), F.col("id").alias("y"))
    across = pairs.join(a, "i").join(b, "j").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")
    inner = a.join(members.where("own").select(F.col("rep").alias("i"), F.col("id").alias("y")), "i").where("x < y")
    return across.unionByName(inner.select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(1.0).alias("similarity")))


def class_leaders(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(leader, member) of cluster.leaders() over all similar ids, from similar_classes().  Equal vectors are similar to the
    same others, so only the least id of a class can lead, and the others follow it or its leader."""
    found = cluster.leaders(pairs.select("i", "j"))
    joined = members.join(found.select(F.col("member").alias("rep"), "leader"), "rep", "left")
    return joined.where(F.col("leader").isNotNull() | (F.col("own") & (F.col("rep") < F.col("id")))).select(F.coalesce("leader", "rep").alias("leader"), F.col("id").alias("member"))
