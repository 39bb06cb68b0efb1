"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training is one pass: every task counts the hashed n-grams of its labelled rows by language, Spark adds the counts,
and the matrix of log probabilities - languages times buckets, at most MATRIX_CELLS numbers - goes to the driver
and is broadcast.  Prediction looks up and adds log probabilities for a batch of texts at a time.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import fresh

#: Hash buckets, and the bound on languages * buckets: with more languages there are fewer buckets.
BUCKETS, MATRIX_CELLS = 1 << 16, 1 << 23
NGRAMS = (1, 2, 3)
#: Characters that are worked on at once.
CHUNK = 1 << 20
UNKNOWN = "und"
RESULT = ("held_out", "lang_pred", "score")


def bucket_count(n_langs: int) -> int:
    """BUCKETS, halved until the matrix keeps to MATRIX_CELLS; below 256 buckets, with more than 32,768 languages, that is
    an error, as then lang holds no languages."""
    b = BUCKETS
    while b * max(1, n_langs) > MATRIX_CELLS:
        b //= 2
    if b < 256:
        raise ValueError(f"{n_langs} different languages are more than a model can tell apart")
    return b


def chunks(texts: list[str]):
    """(first, last) ranges of texts with about CHUNK characters in all; a longer text stands alone."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def grams(texts: list[str], buckets: int):
    """Yields for each n a bucket per character position, and once the first position of each text.
    Texts are lower-cased and framed by a space on either side; positions whose n-gram would run over the end
    of its text get the bucket number `buckets`, which stands for nothing."""
    framed = [f" {t.lower()} " for t in texts]
    size = np.array([len(t) for t in framed])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    left = np.repeat(starts + size, size) - np.arange(len(points))  # characters from here to the text's end
    h = np.zeros(len(points), np.uint64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for n in range(1, max(NGRAMS) + 1):
        ahead = np.zeros(len(points), np.uint64)
        ahead[: len(points) - n + 1] = points[n - 1 :]
        h = h * np.uint64(0x100000001B3) + ahead + np.uint64(n)
        if n in NGRAMS:
            at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            at[left < n] = buckets
            yield at, starts


def count_grams(batches, buckets: int):
    """mapInPandas: (lang, text) to (lang, bucket, n) of this task; bucket -1 counts documents."""
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang", sort=False):
            texts = group["text"].tolist()
            sums = counts.setdefault(lang, np.zeros(buckets + 2, np.int64))
            sums[-1] += len(texts)
            for i, j in chunks(texts):
                for at, _ in grams(texts[i:j], buckets):
                    sums[:-1] += np.bincount(at, minlength=buckets + 1)
    for lang, sums in counts.items():
        sums[buckets] = 0
        full = np.flatnonzero(sums)
        yield pd.DataFrame({"lang": lang, "bucket": np.where(full == buckets + 1, -1, full).astype(np.int32), "n": sums[full]})


def is_held_out(id_col: str):
    """crc32 of the id's text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log prior, and log probabilities (languages, buckets + 1; the last bucket weighs nothing),
    learned from the rows that have text and language and are not held out - all of them."""
    rows = docs.where(~is_held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    buckets = bucket_count(rows.select("lang").distinct().count())
    found = rows.mapInPandas(lambda it: count_grams(it, buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), buckets + 1))
    docs_of = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        text = own[own["bucket"] >= 0]
        counts[k, text["bucket"]] = text["n"]
        docs_of[k] = own.loc[own["bucket"] < 0, "n"].sum()
    logp = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * buckets)
    logp[:, buckets] = 0
    return langs, np.log(docs_of / max(1, docs_of.sum())) if langs else docs_of, logp.astype(np.float32)


def classify(texts: list[str | None], model) -> tuple[list[str], list[float]]:
    """Language and posterior probability for each text; `und`, 0.0 for null, texts without a letter, or no model."""
    langs, prior, logp = model
    said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if t and langs and any(map(str.isalpha, t))]
    own = [texts[i] for i in known]
    for a, b in chunks(own):
        total = np.repeat(prior[:, None], b - a, axis=1)
        for at, starts in grams(own[a:b], logp.shape[1] - 1):
            for k in range(len(langs)):
                total[k] += np.add.reduceat(logp[k][at], starts, dtype=np.float64)
        best = total.argmax(axis=0)
        p = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
        for i, k, s in zip(known[a:b], best, p, strict=True):
            said[i], score[i] = langs[k], float(min(1.0, s))
    return said, score


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model=None) -> DataFrame:
    """docs plus held_out, lang_pred and score.

    Predictions read the text alone.  Null text, text without a letter (empty text too) and an empty training set
    give `und` with score 0.  Equal texts get equal answers; long texts are read whole; ties between languages go
    to the first by name.  Columns of docs keep their names; those named like a result column are replaced.
    """
    docs = docs.drop(*RESULT)
    model = model or train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            said, score = classify([t if isinstance(t, str) else None for t in texts], shared.value)
            yield pd.DataFrame({"lang_pred": said, "score": score})

    (said,) = fresh(docs, "said")
    out = docs.withColumn(said, predict(F.col(text_col))).withColumn("held_out", is_held_out(id_col))
    return out.select(*docs.columns, "held_out", f"{said}.lang_pred", f"{said}.score")


def accepted(docs: DataFrame, *, min_score: float = 0.0, **how) -> DataFrame:
    """docs whose language could be told (not `und`) with at least min_score; columns as they are."""
    return identify(docs, **how).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    """op9_language_id: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The method over one n-gram at a time, for small inputs (doc_id, text, lang): (doc_id, held_out, lang_pred, score)."""

    def found(text: str):
        framed, mask = f" {text.lower()} ", (1 << 64) - 1
        for n in NGRAMS:
            for i in range(len(framed) - n + 1):
                h = 0
                for k, c in enumerate(framed[i : i + n], 1):
                    h = (h * 0x100000001B3 + ord(c) + k) & mask
                yield ((h * 0x9E3779B97F4A7C15) & mask) * BUCKETS >> 64

    out, held = [], {i: crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    learned = [(t, lang) for i, t, lang in docs if not held[i] and t is not None and lang is not None]
    n_docs = Counter(lang for _, lang in learned)
    counts = {lang: Counter(g for t, own in learned if own == lang for g in found(t)) for lang in sorted(n_docs)}
    sums = {lang: math.log(c.total() + 0.5 * BUCKETS) for lang, c in counts.items()}
    for i, text, _ in docs:
        if not counts or not any(map(str.isalpha, text or "")):
            out.append((i, held[i], UNKNOWN, 0.0))
            continue
        own = Counter(found(text))
        logs = {lang: math.log(n_docs[lang] / len(learned)) + sum(n * (math.log(c[g] + 0.5) - sums[lang]) for g, n in own.items()) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        out.append((i, held[i], best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return out
