"""A stored index of vectors: inverted cells that grow in place, and product-quantised codes.

Below a folder lie `vectors`, partitioned by cell (id, v and, with codes, code); `cells`, versions of the table of
centroids, the newest of which counts; and `words`, the codebooks.  Adding appends to cells.  Only cells that hold an
older vector of an added id, and cells that outgrow their bound and are split, are written anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import vectors as V
from lumenfold.sources.tables import exists, forget, recover, replace_partitions, working_folder, written

#: Vectors of a cell beyond which it is split, and the most parts of a split.
MOST, PARTS = 500_000, 16
#: Rows of one small side that may be broadcast.
SMALL = 1_000_000
#: Centroids of a codebook: a code is a byte for each part of a vector.
WORDS = 256


def _centres(spark: SparkSession, folder: str) -> tuple[int, np.ndarray]:
    """The newest version of the centroids; their numbers are those of the cells."""
    table = spark.read.schema("version long, cell int, centre array<double>").parquet(f"{folder}/cells")
    version = table.agg(F.max("version")).first()[0]
    cells = table.where(F.col("version") == version).orderBy("cell").toPandas()
    return version, V.stack(cells["centre"])


def _write_centres(spark: SparkSession, folder: str, version: int, centres: np.ndarray) -> None:
    """One file, so a version is there as a whole or not at all."""
    rows = [(version, k, [float(x) for x in c]) for k, c in enumerate(centres)]
    spark.createDataFrame(rows, "version long, cell int, centre array<double>").coalesce(1).write.mode("append").parquet(f"{folder}/cells")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    """The vectors (id, v, cell and, where there are codes, code) and the centroids."""
    recover(spark, f"{folder}/vectors")
    return spark.read.parquet(f"{folder}/vectors").withColumn("cell", F.col("cell").cast("int")), _centres(spark, folder)[1]


def create(vectors: DataFrame, folder: str, *, n_cells: int = 16, parts: int = 0, id_col: str = "vec_id", vector: str = "embedding") -> None:
    """Keep an index of all vectors below `folder`, which is replaced.  `parts` bytes a vector make codes; it must divide
    the dimension.  Centroids and codebooks are fitted on the sample of V.fit_cells()."""
    spark = vectors.sparkSession
    forget(spark, folder)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    centres = V.fit_cells(rows, n_cells, vector="v")
    _write_centres(spark, folder, 1, centres)
    placed = V.with_cells(rows, centres, vector="v")
    if parts:
        words = fit_words(placed, centres, parts)
        table = [(p, w, [float(x) for x in x]) for p, book in enumerate(words) for w, x in enumerate(book)]
        spark.createDataFrame(table, "part int, word int, value array<double>").coalesce(1).write.parquet(f"{folder}/words")
        placed = coded(placed, centres, words)
    placed.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(32))).write.partitionBy("cell").parquet(f"{folder}/vectors")


def _words(spark: SparkSession, folder: str) -> np.ndarray | None:
    if not exists(spark, f"{folder}/words"):
        return None
    table = spark.read.parquet(f"{folder}/words").orderBy("part", "word").toPandas()
    return V.stack(table["value"]).reshape(int(table["part"].max()) + 1, -1, len(table["value"].iloc[0]))


def add(vectors: DataFrame, folder: str, *, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST) -> dict[str, list[int]]:
    """Put vectors into the index; one with the id of another replaces it.  Of several rows of an id one stays, the largest;
    null vectors are left out.  Returns the cells that were appended to, rewritten and split.

    What is there already stays as it is, so adding twice changes nothing, and an addition that was interrupted may be
    repeated.  Centroids aren't fitted again but for cells with more than `most` vectors.
    """
    spark, work = vectors.sparkSession, working_folder(vectors.sparkSession)
    indexed, centres = read(spark, folder)
    words = _words(spark, folder)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(indexed.schema["v"].dataType).alias("v")).where("v is not null")
    new = V.with_cells(rows.groupBy("id").agg(F.max("v").alias("v")), centres, vector="v")
    new = written(new if words is None else coded(new, centres, words), f"{work}/new").select(*indexed.columns)
    ids = new.select("id")
    near = F.broadcast(ids) if ids.count() <= SMALL else ids
    # ids and cells only: the vectors of other cells aren't read
    older = [r["cell"] for r in indexed.select("id", "cell").join(near, "id", "left_semi").select("cell").distinct().collect()]
    touched: list[int] = []
    if older:
        stored = indexed.where(F.col("cell").isin(older)).select("id", F.col("v").alias("was"), F.col("cell").alias("of"))
        both = written(stored.join(new.select("id", "v"), "id").groupBy("id").agg(F.every(F.col("v") == F.col("was")).alias("same"), F.count("*").alias("n"), F.collect_set("of").alias("of")), f"{work}/both")
        changed = both.where("not same or n > 1")
        new = written(new.join(both.where("same and n = 1").select("id"), "id", "left_anti").select(*indexed.columns), f"{work}/changed")
        touched = sorted(r["c"] for r in changed.select(F.explode("of").alias("c")).distinct().collect())
    appended = new.where(~F.col("cell").isin(touched)) if touched else new
    reached = sorted(r["cell"] for r in appended.select("cell").distinct().collect())
    if reached:
        appended.repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{folder}/vectors")
    if touched:
        here = indexed.where(F.col("cell").isin(touched))
        rest = here.join(changed.select("id"), "id", "left_anti").select(*indexed.columns)
        kept = written(rest.unionByName(new.where(F.col("cell").isin(touched))), f"{work}/kept")
        left = {r["cell"] for r in kept.select("cell").distinct().collect()}
        replace_partitions(kept, f"{folder}/vectors", ["cell"])
        forget(spark, *[f"{folder}/vectors/cell={c}" for c in touched if c not in left])
    forget(spark, work)
    return {"appended": reached, "rewritten": touched, "split": split(spark, folder, most)}


def split(spark: SparkSession, folder: str, most: int = MOST) -> list[int]:
    """Split cells of more than `most` vectors around centroids of their own; others aren't touched.  A cell of equal
    vectors can't be split and stays."""
    indexed, _ = read(spark, folder)
    large = [(r["cell"], r["n"]) for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
    done = []
    for cell, n in sorted(large):
        indexed, centres = read(spark, folder)
        version, words = _centres(spark, folder)[0], _words(spark, folder)
        rows = indexed.where(F.col("cell") == cell).drop("cell")
        inner = np.unique(V.fit_cells(rows, min(PARTS, -(-2 * n // most)), vector="v"), axis=0)
        if len(inner) < 2:
            continue
        # centroids come first: until its vectors have moved, the cell is found by its own number still
        numbers = np.array([cell, *range(len(centres), len(centres) + len(inner) - 1)])
        grown = np.vstack((centres, inner[1:]))
        grown[cell] = inner[0]
        _write_centres(spark, folder, version + 1, grown)
        shared = F.array(*[F.lit(int(x)) for x in numbers])
        moved = V.with_cells(rows.select("id", "v"), inner, vector="v").withColumn("cell", F.element_at(shared, F.col("cell") + 1))
        moved = moved if words is None else coded(moved, grown, words)
        replace_partitions(moved.select(*indexed.columns), f"{folder}/vectors", ["cell"])
        done.append(cell)
    return done


# ---- codes

def fit_words(placed: DataFrame, centres: np.ndarray, parts: int, *, max_rows: int = 50_000) -> np.ndarray:
    """Codebooks (parts, words, numbers of a part) for what vectors differ by from their centroids, by k-means over at most
    max_rows vectors, the documented bound of the fit."""
    sample = placed.orderBy(F.xxhash64("v")).limit(max_rows).select("v", "cell").toPandas()
    x = V.stack(sample["v"]) - centres[sample["cell"].to_numpy()] if len(sample) else np.zeros((1, centres.shape[1] or parts))
    if x.shape[1] % parts:
        raise ValueError(f"{parts} parts don't divide {x.shape[1]} numbers")
    rng, books = np.random.default_rng(5), []
    for piece in np.split(x, parts, axis=1):
        words = piece[rng.choice(len(piece), min(WORDS, len(piece)), replace=False)]
        for _ in range(12):
            own = V.distances(piece, words, "l2").argmin(axis=1)
            sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
            np.add.at(sums, own, piece)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        books.append(np.vstack((words, np.zeros((WORDS - len(words), words.shape[1])))))
    return np.stack(books)


def coded(placed: DataFrame, centres: np.ndarray, words: np.ndarray) -> DataFrame:
    """placed (id, v, cell) plus code, a byte for each part."""
    shared = placed.sparkSession.sparkContext.broadcast((centres, words))

    @F.pandas_udf("binary")
    def codes(v: pd.Series, cell: pd.Series) -> pd.Series:
        centres, words = shared.value
        x = V.stack(v) - centres[cell.to_numpy()]
        best = [V.distances(piece, book, "l2").argmin(axis=1) for piece, book in zip(np.split(x, len(words), axis=1), words, strict=True)]
        return pd.Series([row.tobytes() for row in np.stack(best, axis=1).astype(np.uint8)])

    return placed.withColumn("code", codes("v", "cell"))


def search_codes(spark: SparkSession, folder: str, queries: DataFrame, k: int, *, probes: int = 4, candidates: int = 100, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, similarity): each query looks into its `probes` nearest cells, estimates distances by a table
    for each part of its vector, and measures the best `candidates` by their stored vectors.  Only codes are read but
    for those.  Approximate; queries go in blocks as in V.knn_join()."""
    indexed, centres = read(spark, folder)
    words = _words(spark, folder)
    if words is None:
        raise ValueError("the index has no codes: create it with parts")

    def search(q_ids: np.ndarray, q: np.ndarray) -> DataFrame:
        probed = np.argsort(V.distances(q, centres, "l2"), axis=1, kind="stable")[:, :probes] if len(q) else np.zeros((0, 1), int)
        shared = spark.sparkContext.broadcast((q_ids, q, probed, centres, words))

        def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q_ids, q, probed, centres, words = shared.value
            kept: dict[int, pd.DataFrame] = {}
            for batch in batches:
                for cell, part in batch.groupby("cell"):
                    codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    ids = part["id"].to_numpy()
                    for row in np.flatnonzero((probed == cell).any(axis=1)).tolist():
                        pieces = np.split(q[row] - centres[cell], len(words))
                        tables = np.stack([((book - piece) ** 2).sum(axis=1) for book, piece in zip(words, pieces, strict=True)])
                        d = tables[np.arange(len(words))[None, :], codes].sum(axis=1)
                        at = np.argpartition(d, candidates - 1)[:candidates] if len(d) > candidates else np.arange(len(d))
                        found = pd.DataFrame({"id": ids[at], "cell": int(cell), "d": d[at]})
                        kept[row] = pd.concat((kept[row], found)).nsmallest(candidates, "d") if row in kept else found
            for row, found in kept.items():
                yield found.assign(query_id=q_ids[row])[["query_id", "id", "cell", "d"]]

        rows = indexed.where(F.col("cell").isin([int(c) for c in np.unique(probed)])).select("id", "cell", "code")
        rough = rows.mapInPandas(estimate, "query_id long, id long, cell int, d double")
        best = written(V.ranked(rough.withColumn("id", F.struct("id", "cell")), candidates).select("query_id", "id.id", "id.cell"), f"{working_folder(spark)}/candidates")
        known = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(q_ids, q, strict=True)], "query_id long, q array<double>")
        near = F.broadcast(best) if best.count() <= SMALL else best
        full = indexed.select("id", "cell", "v").join(near, ["id", "cell"]).join(F.broadcast(known), "query_id")
        gap = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return V.scored(V.ranked(full.select("query_id", "id", gap.alias("d")), k), "l2")

    return V.in_blocks(queries, id_col, vector, search)
