"""Quality classifier by co-training.

Two views of a document are classified apart: its text (words, word ends, repeated words, and layout figures such as
lines and the shares of symbols, capitals and distinct words), and its page metadata (source, language, told length,
host and depth of the URL), of which nothing is computed from the text.
Both are naive Bayes over hashed features, so a training round is one pass that adds counts: labelled rows count for
both views; of the other rows those that one view is sure about count, as it says, for the other view.  After the
rounds both views are calibrated on held-out labelled rows, combined, and score all documents.
What goes to the driver has a fixed size: counts by class and bucket, and calibration rows by score bin.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import fresh, small_side
from lumenfold.llm.textnp import mix, range_digests, text_chunks, words

#: Hash buckets of either view; score bins for calibration, and their width.
TEXT_BUCKETS, META_BUCKETS, BINS, BIN = 1 << 16, 1 << 12, 64, 0.25
META = ("source", "lang", "n_chars", "url")
RESULT = ("text_score", "meta_score", "quality_score", "kept")
COUNTS = "view int, label int, bucket int, n double"


def _level(x: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum((x * steps).astype(np.int64), steps)


def meta_buckets(meta: list[pa.Array]) -> np.ndarray:
    """Buckets (rows, k) of the metadata alone; missing values are values of their own."""
    source, lang, size, url = (m.to_pylist() for m in meta)
    size = np.nan_to_num(pd.to_numeric(pd.Series(size, dtype=object), errors="coerce").to_numpy(dtype=float), nan=-1)
    urls = [u.split("//", 1)[-1].split("/") if isinstance(u, str) else [None] for u in url]
    named = {
        "source": source, "lang": lang, "both": [f"{a}/{b}" for a, b in zip(source, lang, strict=True)], "size": [int(np.log2(x + 1) * 2) if x >= 0 else None for x in size],
        "host": [u[0] for u in urls], "depth": [len(u) for u in urls],
    }
    hashed = [[crc32(f"{name}={v}".encode()) for v in values] for name, values in named.items()]
    return (np.array(hashed, np.uint64).T.reshape(len(source), len(named)) % np.uint64(META_BUCKETS)).astype(np.int64)


def features(texts: pa.Array):
    """Yields for chunks of texts: first row, number of rows, buckets of words, the row of each, and buckets (rows, k)
    of the layout.  The arrays of a chunk take some 40 times its bytes, so callers hold one at a time."""
    for first, data, offsets in text_chunks(texts):
        rows = len(offsets) - 1
        starts, ends, of = words(data, offsets)
        n = np.diff(of)
        doc = np.repeat(np.arange(rows), n)
        h, _ = range_digests(data, starts, ends)
        tail = mix(range_digests(data, np.maximum(starts, ends - 3), ends)[0] + np.uint64(5))
        again = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))[: len(h)]
        flat = np.concatenate((h, tail, mix(again.astype(np.uint64) + np.uint64(9))))
        at, owner = (flat % np.uint64(TEXT_BUCKETS)).astype(np.int64), np.tile(doc, 3)
        length = np.maximum(np.diff(offsets), 1)

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(mask)))  # noqa: B023
            return (total[offsets[1:]] - total[offsets[:-1]]) / length  # noqa: B023

        upper = (data >= 65) & (data <= 90)
        mark = (data > 32) & (data < 128) & ~upper & ~((data >= 97) & (data <= 122))
        order = np.lexsort((h, doc))
        fresh_word = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])))[: len(h)]
        distinct = np.bincount(doc[order][fresh_word], minlength=rows) / np.maximum(n, 1)
        layout = [_level(share(upper), 20), _level(share(mark), 20), _level(share(data == 10) * 20, 20), _level(distinct, 20), _level(np.minimum(n, 1 << 20) ** 0.25 / 32, 40)]
        layout = np.column_stack([mix(v.astype(np.uint64) + np.uint64(1000 * (k + 1))) for k, v in enumerate(layout)])
        yield first, rows, at, owner, (layout % np.uint64(TEXT_BUCKETS)).astype(np.int64)


class Model:
    """Log odds by bucket of both views, from counts by view, label and bucket; unseen buckets say nothing."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 1.0):
        self.odds = []
        for view, buckets in enumerate((TEXT_BUCKETS, META_BUCKETS)):
            c = np.zeros((2, buckets))
            own = counts[counts["view"] == view]
            np.add.at(c, (own["label"], own["bucket"]), own["n"])
            seen = (c > 0).sum(axis=1).max()
            p = np.log((c + smoothing) / (c.sum(axis=1, keepdims=True) + smoothing * max(1, seen)))
            self.odds.append(np.where(c.sum(axis=0) > 0, p[1] - p[0], 0.0))
        self.calibration = [np.array([0.0, 0.0]), np.array([0.0, 0.0]), np.array([0.0, 0.0, 0.0])]

    def raw(self, at: np.ndarray, owner: np.ndarray, layout: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Log odds of both views for each row of a chunk, from features() and meta_buckets(); those of a text's words
        are divided by the root of their number."""
        total = np.bincount(owner, self.odds[0][at], len(meta))
        text = total / np.sqrt(np.maximum(np.bincount(owner, minlength=len(meta)), 1)) + self.odds[0][layout].sum(axis=1)
        return np.column_stack((text, self.odds[1][meta].sum(axis=1)))

    def raw_of(self, text: pa.Array, meta: list[pa.Array]) -> np.ndarray:
        """raw() of all rows of a batch, a chunk at a time."""
        buckets = meta_buckets(meta)
        return np.concatenate([np.zeros((0, 2)), *(self.raw(at, owner, layout, buckets[first : first + rows]) for first, rows, at, owner, layout in features(text))])

    def scores(self, raw: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1: text view, metadata view, both together."""
        x = np.clip(raw, -BINS * BIN / 2, BINS * BIN / 2)
        t, m, both = self.calibration
        z = np.column_stack((t[0] + t[1] * x[:, 0], m[0] + m[1] * x[:, 1], both[0] + both[1] * x[:, 0] + both[2] * x[:, 1]))
        return 1 / (1 + np.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression with intercept, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def joined(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, META, label, fold): label null where there is none; the mean of several, rounded."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    meta = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in META]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *meta)
    return rows.join(small_side(known), "id", "left").withColumn("fold", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)))


def count_batches(batches: Iterator[pa.RecordBatch], model: Model | None, sure: float) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (text, META, label) to COUNTS, a chunk of texts at a time."""
    sums = [np.zeros((2, TEXT_BUCKETS)), np.zeros((2, META_BUCKETS))]
    for batch in batches:
        buckets = meta_buckets([batch[c] for c in META])
        labels = batch["label"].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        for first, rows_, at, owner, layout in features(batch["text"]):
            meta, label = buckets[first : first + rows_], labels[first : first + rows_]
            says = np.column_stack((label, label))
            if model is not None:
                p = model.scores(model.raw(at, owner, layout, meta))[:, :2]
                told = np.where(p >= sure, 1.0, np.where(p <= 1 - sure, 0.0, np.nan))
                says = np.where(np.isnan(says), told[:, ::-1], says)  # each view learns what the other is sure of
            for y in (0, 1):
                own = says[:, 0] == y
                sums[0][y] += np.bincount(at[own[owner]], minlength=TEXT_BUCKETS) + np.bincount(layout[own].reshape(-1), minlength=TEXT_BUCKETS)
                sums[1][y] += np.bincount(meta[says[:, 1] == y].reshape(-1), minlength=META_BUCKETS)
    for view, c in enumerate(sums):
        for y in (0, 1):
            full = np.flatnonzero(c[y])
            own = [np.full(len(full), view), np.full(len(full), y), full]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in own), pa.array(c[y][full])], names=["view", "label", "bucket", "n"])


def count_pass(rows: DataFrame, model: Model | None, sure: float) -> pd.DataFrame:
    """Counts of one round: labelled rows (outside the calibration fold) for both views; with a model, other rows for
    the view whose counterpart is sure about them."""
    used = rows.where("label is not null and fold <> 0" if model is None else "label is null or fold <> 0")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return used.select("text", *META, "label").mapInArrow(lambda it: count_batches(it, shared.value, sure), COUNTS).groupBy("view", "label", "bucket").agg(F.sum("n").alias("n")).toPandas()


def calibrate(rows: DataFrame, model: Model) -> None:
    """Fit the calibration on the labelled rows of fold 0, which arrive as counts by score bins."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw_of(batch["text"], [batch[c] for c in META])
            at = np.clip((raw / BIN + BINS / 2).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), batch["label"]], names=["t", "m", "label"])

    own = rows.where("label is not null and fold = 0").select("text", *META, "label")
    bins = own.mapInArrow(binned, "t int, m int, label int").groupBy("t", "m", "label").agg(F.count("*").alias("n")).toPandas()
    if bins["label"].nunique() < 2:  # nothing to tell apart
        share = np.log(9) if not len(bins) or bins["label"].iloc[0] else -np.log(9)
        model.calibration = [np.array([share, 0.0]), np.array([share, 0.0]), np.array([share, 0.0, 0.0])]
        return
    x = (bins[["t", "m"]].to_numpy() - BINS / 2 + 0.5) * BIN
    y, w = bins["label"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float)
    model.calibration = [logistic(x[:, :1], y, w), logistic(x[:, 1:], y, w), logistic(x, y, w)]


def train(docs: DataFrame, labels: DataFrame, *, rounds: int = 2, sure: float = 0.98, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model after co-training over all rows; fold 0 of the labelled rows is kept for calibration."""
    rows = joined(docs, labels, id_col, text_col, label_col)
    model = Model(count_pass(rows, None, sure))
    for _ in range(rounds):
        calibrate(rows, model)
        model = Model(count_pass(rows, model, sure))
    calibrate(rows, model)
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, rounds: int = 2, sure: float = 0.98, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", model: Model | None = None) -> DataFrame:
    """docs plus text_score, meta_score and quality_score (calibrated probabilities of label 1) and kept
    (quality_score >= threshold).

    Null and empty texts are judged by their metadata; missing or null metadata is a value of its own.  Several labels
    of a document count as their rounded mean, null labels as none; without labels of both kinds all rows score alike.
    Repeated rows score alike; an empty table gives no rows.  Columns of docs keep their names; those named like a
    result column are replaced.
    """
    docs = docs.drop(*RESULT)
    model = model or train(docs, labels, rounds=rounds, sure=sure, id_col=id_col, text_col=text_col, label_col=label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("text_score double, meta_score double, quality_score double")
    def score(text: pa.Array, *meta: pa.Array) -> pa.Array:
        p = shared.value.scores(shared.value.raw_of(text, list(meta)))
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], names=["text_score", "meta_score", "quality_score"])

    meta = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in META]
    (said,) = fresh(docs, "said")
    out = docs.withColumn(said, score(F.col(text_col).cast("string"), *meta)).select(*docs.columns, f"{said}.*")
    return out.withColumn("kept", F.col("quality_score") >= threshold)


def op2(spark, sf_dir: str) -> DataFrame:
    """op2_quality: one row per document."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify_quality(docs, labels).select("doc_id", *RESULT)


def brute_force(docs: list[tuple], labels: dict, rounds: int, sure: float) -> tuple[list[tuple], int]:
    """The method over one feature at a time, by names instead of hashes, for small inputs (doc_id, text, source, lang,
    n_chars, url): (doc_id, text_score, meta_score, quality_score), and how many pseudo-labels the last round gave."""

    def of_text(text: str | None) -> tuple[list, list]:
        data = (text or "").encode()
        w, size = data.split(), max(1, len(data))
        small = [("word", x) for x in w] + [("end", x[-3:]) for x in w] + [("again", i > 0 and x == w[i - 1]) for i, x in enumerate(w)]
        upper = sum(65 <= b <= 90 for b in data)
        mark = sum(32 < b < 128 and not 65 <= b <= 90 and not 97 <= b <= 122 for b in data)
        shares = [upper / size, mark / size, data.count(b"\n") / size * 20, len(set(w)) / max(1, len(w))]
        steps = [min(20, int(x * 20)) for x in shares] + [min(40, int(min(len(w), 1 << 20) ** 0.25 / 32 * 40))]
        return small, [("layout", k, x) for k, x in enumerate(steps)]

    def of_meta(source, lang, n_chars, url) -> list:
        parts = url.split("//", 1)[-1].split("/") if url else [None]
        size = None if n_chars is None else int(math.log2(n_chars + 1) * 2)
        return [("source", source), ("lang", lang), ("both", source, lang), ("size", size), ("host", parts[0]), ("depth", len(parts))]

    rows = [(i, *of_text(text), of_meta(*meta), labels.get(i), crc32(str(i).encode()) % 5) for i, text, *meta in docs]

    def learn(says: list[tuple]) -> list[dict]:
        odds = []
        for view in (0, 1):
            c = [Counter(), Counter()]
            for (_, small, layout, meta, _, _), told in zip(rows, says, strict=True):
                if told[view] is not None:
                    c[int(told[view])].update([*small, *layout] if view == 0 else meta)
            seen, total = max(1, len(c[0]), len(c[1])), [c[0].total(), c[1].total()]
            p = [{g: math.log((c[y][g] + 1) / (total[y] + seen)) for g in {*c[0], *c[1]}} for y in (0, 1)]
            odds.append({g: p[1][g] - p[0][g] for g in p[0]})
        return odds

    def raw(odds: list[dict]) -> np.ndarray:
        get = lambda view, names: sum(odds[view].get(g, 0.0) for g in names)
        return np.array([(get(0, small) / math.sqrt(max(1, len(small))) + get(0, layout), get(1, meta)) for _, small, layout, meta, _, _ in rows])

    def scores(x: np.ndarray) -> np.ndarray:
        own = [k for k, r in enumerate(rows) if r[4] is not None and r[5] == 0]
        y = np.array([rows[k][4] for k in own], float)
        binned = (np.clip((x[own] / BIN + BINS / 2).astype(int), 0, BINS - 1) - BINS / 2 + 0.5) * BIN
        fits = [([0], logistic(binned[:, :1], y, np.ones(len(y)))), ([1], logistic(binned[:, 1:], y, np.ones(len(y)))), ([0, 1], logistic(binned, y, np.ones(len(y))))]
        x = np.clip(x, -BINS * BIN / 2, BINS * BIN / 2)
        return np.column_stack([1 / (1 + np.exp(-(w[0] + x[:, cols] @ w[1:]))) for cols, w in fits])

    given = [r[4] if r[5] else None for r in rows]
    odds, pseudo = learn([(y, y) for y in given]), 0
    for _ in range(rounds):
        told = [[1 if p >= sure else 0 if p <= 1 - sure else None for p in row[:2]] for row in scores(raw(odds))]
        says = [(y, y) if r[4] is not None else (t[1], t[0]) for r, y, t in zip(rows, given, told, strict=True)]
        pseudo = sum(x is not None for r, s in zip(rows, says, strict=True) if r[4] is None for x in s)
        odds = learn(says)
    return [(r[0], *map(float, p)) for r, p in zip(rows, scores(raw(odds)), strict=True)], pseudo
