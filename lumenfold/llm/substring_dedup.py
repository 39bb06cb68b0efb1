"""Substring dedup by fixed-block anchors.

Words are runs of anything but the six ASCII spaces.  A window is `window` consecutive words of a document; words that
a window covers are removed if the same words also start in a document with a smaller id.

1. Reference blocks are the non-overlapping blocks of (window + 1) / 2 words of every document: any window holds one
   of them whole.  Every rolling window of a block's length probes the blocks, by packed exchange.
2. Around hits (and only there) whole windows meet by 128 bits over the digests of their words; a window is a repeat if the
   smallest id among its holders is smaller than its own.  Touching repeats grow together to maximal ones.
3. Each document drops the words that its repeats cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import exchange as X
from lumenfold.llm.shared import forget, fresh, release, shared_dir, stash
from lumenfold.llm.textnp import range_digests, ranges, text_chunks, window_hash, words

#: A null id sorts before all others.
NO_ID = -(1 << 63)
RESULT = ("n_words", "n_removed", "removed_spans", "kept_text")


def hashed_words(batch):
    """For each chunk of a batch of (id, text): its first row, ids, first word of each text, and the words' digests."""
    ids = np.asarray(batch.column(0))
    for first, data, offsets in text_chunks(batch.column(1)):
        starts, ends, of = words(data, offsets)
        yield first, ids[first : first + len(offsets) - 1], of, range_digests(data, starts, ends)


def probe_blocks(batches, block: int, n_slices: int):
    """mapInArrow, step 1: (id, text) to exchange rows; an entry is (block hash, is a reference block)."""

    def parts():
        for batch in batches:
            for _, ids, of, (h, _) in hashed_words(batch):
                n = np.diff(of)
                probes = np.maximum(n - block + 1, 0)
                pos = ranges(np.zeros(len(n), np.int64), probes)
                doc = np.repeat(np.arange(len(n)), probes)
                yield ids, doc, pos, window_hash(h, block)[of[:-1][doc] + pos]

    for seq, (ids, doc, pos, key) in enumerate(X.gathered(parts())):
        number = X.batch_number(seq)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(new, append=len(key))
        again = np.zeros(len(key), bool)
        again[order] = np.repeat(count > 1, count)  # met twice here: whole windows are looked at anyway
        is_ref = pos % block == 0
        has_ref = np.maximum.reduceat(is_ref[order], new) if len(new) else np.zeros(0, bool)
        one = np.sort(order[new])
        flag = np.zeros(len(key), bool)
        flag[order[new]] = has_ref
        yield from X.settled(number, n_slices, doc[again], pos[again], ids)
        yield from X.deal(number, n_slices, key[one], doc[one], pos[one], ids, "<u4", flag[one].astype(np.uint8))


def block_hits(ids: np.ndarray, pos: np.ndarray, keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Entries whose block hash came from several batches, once at least as a reference block."""
    is_ref = np.concatenate([np.frombuffer(m, np.uint8) for m in rows["more"]])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    count = np.diff(new, append=len(k))
    good = (count > 1) & (np.maximum.reduceat(is_ref[order], new) > 0)
    said = np.full(len(keys), X.OPEN)
    said[order] = np.where(np.repeat(good, count), X.REPEAT, X.OPEN)
    return said


def whole_windows(batches, window: int, block: int, n_slices: int):
    """mapInArrow, step 2: (id, text, runs of hit blocks) to exchange rows; an entry is the hash of a whole window."""

    def parts():
        for batch in batches:
            runs = batch.column(2).to_pylist()
            for first, ids, of, hs in hashed_words(batch):
                n = np.diff(of)
                at = [np.flatnonzero(X.run_cover(runs[first + i], max(0, n[i] - window + 1), before=window - block)) for i in range(len(n))]
                doc = np.repeat(np.arange(len(n)), [len(a) for a in at])
                pos = np.concatenate(at) if at else np.zeros(0, np.int64)
                where = of[:-1][doc] + pos
                yield ids, doc, pos, window_hash(hs[0], window)[where], window_hash(hs[1], window)[where]

    for seq, (ids, doc, pos, key, check) in enumerate(X.gathered(parts(), X.BATCH // 2)):
        number = X.batch_number(seq)
        owner = ids[doc]
        order = np.lexsort((owner, check, key))
        k, c, o = key[order], check[order], owner[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        least = np.repeat(o[first], np.diff(first, append=len(k)))
        late = np.zeros(len(key), bool)
        late[order] = o > least
        yield from X.settled(number, n_slices, doc[late], pos[late], ids)
        rest = np.flatnonzero(~late)
        yield from X.deal(number, n_slices, key[rest], doc[rest], pos[rest], ids, "<u8", check[rest])


def later_windows(ids: np.ndarray, pos: np.ndarray, keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Entries whose window also starts in a document with a smaller id."""
    check = np.concatenate([np.frombuffer(m, "<u8") for m in rows["more"]])
    order = np.lexsort((ids, check, keys))
    k, c, o = keys[order], check[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
    said = np.full(len(keys), X.OPEN)
    said[order] = np.where(o > np.repeat(o[first], np.diff(first, append=len(k))), X.REPEAT, X.OPEN)
    return said


def repeated_windows(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs): for documents that have any, runs (start, length) of word positions where a repeat starts."""
    spark, folder, block = docs.sparkSession, shared_dir(docs.sparkSession), (window + 1) // 2
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    n = X.n_slices(texts)
    hits = stash(X.settle(texts.mapInArrow(lambda it: X.to_arrow(probe_blocks(it, block, n)), X.ROWS), block_hits, "<u4"), folder, "hits")
    release(spark)
    near = texts.join(hits, "id").mapInArrow(lambda it: X.to_arrow(whole_windows(it, window, block, n)), X.ROWS)
    found = stash(X.settle(near, later_windows, "<u8"), folder, "repeats")
    del near, hits
    release(spark)
    forget(spark, f"{folder}/hits")
    return found


STRIPPED = "n_words long, n_removed long, removed_spans array<struct<first:int,last:int>>, kept_text string"


def strip(text: pd.Series, runs: pd.Series, w: int) -> pd.DataFrame:
    """STRIPPED for each text and its runs of repeats."""
    out = []
    for t, r in zip(text, runs, strict=True):
        own = t.encode().split() if isinstance(t, str) else []
        if not r:
            out.append((len(own), 0, [], b" ".join(own).decode()))
            continue
        gone = X.run_cover(r, len(own), more=w - 1)
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        kept = b" ".join([own[i] for i in np.flatnonzero(~gone)]).decode()
        out.append((len(own), int(gone.sum()), [{"first": int(a), "last": int(b)} for a, b in edge], kept))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "removed_spans", "kept_text"])


def substring_dedup(docs: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_words, n_removed, removed_spans (word ranges, last excluded) and kept_text (kept words, joined
    by one space).

    Null and empty texts have no words.  A null id sorts before all others.  Rows that repeat an id count as one
    document, so nothing in them is older than the rest; each gets the marks of all.  Texts are read whole.
    Columns of docs keep their names; input columns named like a result column are replaced.
    """
    docs = docs.drop(*RESULT)
    found = X.whole_runs(repeated_windows(docs, window=window, id_col=id_col, text_col=text_col))

    @F.pandas_udf(STRIPPED)
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return strip(text, runs, window)

    key, runs, out = fresh(docs, "key", "runs", "out")
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(found.toDF(key, runs), key, "left")
    return rows.withColumn(out, cut(F.col(text_col), F.col(runs))).select(*docs.columns, f"{out}.*")


def op6(spark, sf_dir: str) -> DataFrame:
    """op6_substring_dedup: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE doc_id > first_id),
k AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
t AS (SELECT k.doc_id, string_agg(x, ' ' ORDER BY k.p) FILTER (r.p IS NULL) AS kept, count(r.p) AS n FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.p = k.p GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""


def brute_force(docs: list[tuple], window: int = 13) -> list[tuple]:
    """The contract, word for word, for small inputs: (doc_id, n_words, n_removed, kept_sha256)."""
    first: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
