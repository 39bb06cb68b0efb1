"""Suffix dedup: repeated byte strings found by merging Burrows-Wheeler transforms of shards.

A window is `length` bytes of one document.  Bytes that a window covers are removed if the same bytes also start
earlier: in a document with a smaller id, or further to the front of the same one.

1. Anchors: each window is owned by the smallest hash among its `GRAM`-byte substrings (the leftmost of equals), so
   equal windows have equal anchors at equal offsets.  Neighbouring windows with one anchor form a snippet.
   Snippets of all documents meet by anchor in a packed exchange.  Copies of a snippet are repeats as a whole;
   anchors with one distinct snippet are settled.  What is left are the edges of repeats.
2. The earliest copies of distinct snippets with one anchor are dealt by anchor.  A task splits them into shards,
   sorts each shard's rotations, and merges the shards' transforms by refining their interleave, two symbols a
   pass: after length / 2 passes every block of the interleave is a set of rotations with a common prefix of
   `length` bytes - a repeated interval - without sorting the merged rotations again.
3. An anchor with very many distinct snippets (a line that a third of all documents share, each with other
   neighbours) would be too much for one task: its windows meet one by one by their 128-bit hash instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm import exchange as X
from lumenfold.llm.shared import forget, fresh, release, shared_dir, stash
from lumenfold.llm.substring_dedup import NO_ID
from lumenfold.llm.textnp import mix, range_digests, ranges, text_chunks

#: Bytes of an anchor; distinct snippets of one anchor that a batch sends on and that a slice compares by transform.
GRAM, HOT_BATCH, HOT_SLICE = 16, 32, 4096
#: Bytes that are merged at once - up to 2**16 positions have 16-bit ranks, which sort in linear time - and of a shard.
PACK, SHARD = 1 << 16, 1 << 14
#: Symbols that a pass of the interleave refinement looks at.
STEP = 8
RESULT = ("n_bytes", "n_removed", "removed_spans", "kept_bytes")
SNIPPETS = "slice int, key long, id long, start int, windows int, data binary"
_ARROW = pa.schema([("slice", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("data", pa.binary())])


def gram_hash(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on."""
    load, have = data.astype(np.uint64), 1
    while have < 8 and 2 * have <= n:  # numbers of 1, 2, 4, 8 bytes
        load = load[:-have] | (load[have:] << np.uint64(8 * have))
        have *= 2
    count = len(data) - n + 1
    out = mix(load[:count])
    for at in range(have, n, have):
        at = min(at, n - have)
        out = mix(out + load[at : at + count])
    return out


def snippets(data: np.ndarray, offsets: np.ndarray, length: int):
    """For the snippets of some texts: text number, first window (in its text), number of windows, anchor hash, and
    a hash of all their bytes and the anchor's offset."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = min(GRAM, length)
    hashes = gram_hash(data, gram)
    at = np.arange(len(data) - gram + 1)
    low = (hashes & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    span, have = length - gram + 1, 1
    while have < span:  # minimum over `have` positions, doubled
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    where = ranges(offsets[:-1], n)
    if not len(where):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (low[where] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    windows = np.diff(new, append=len(where))
    start, own = where[new], anchor[new]
    whole, _ = range_digests(data, start, start + windows - 1 + length)
    return doc[new], start - offsets[:-1][doc[new]], windows, hashes[own], mix(whole + (own - start).astype(np.uint64))


def deal_snippets(batches, length: int, n_slices: int):
    """mapInArrow, step 1: (id, text) to exchange rows; an entry is (anchor hash, hash of the snippet)."""

    def parts():
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, data, offsets in text_chunks(batch.column(1)):
                yield ids[first : first + len(offsets) - 1], *snippets(data, offsets, length)

    for seq, (ids, doc, pos, windows, key, variant) in enumerate(X.gathered(parts(), X.BATCH // 3)):
        if not len(key):
            continue
        number = X.batch_number(seq)
        order = np.lexsort((pos, ids[doc], variant, key))
        k, v = key[order], variant[order]
        new_key = np.concatenate(([True], k[1:] != k[:-1]))
        new = new_key | np.concatenate(([True], v[1:] != v[:-1]))
        again = np.sort(order[~new])
        yield from X.settled(number, n_slices, doc[again], pos[again], ids, windows[again])
        first = order[new]
        nth = np.arange(len(first)) - np.maximum.accumulate(np.where(new_key[new], np.arange(len(first)), 0))
        extra = np.sort(first[nth >= HOT_BATCH])  # of anchors that are very common in this batch already
        yield from X.settled(number, n_slices, doc[extra], pos[extra], ids, windows[extra], X.BY_WINDOW)
        sent = np.sort(first[nth < HOT_BATCH])
        crowd = np.zeros(len(key), bool)
        crowd[first[nth >= HOT_BATCH]] = True
        hot = np.isin(key[sent], key[crowd])
        more = np.rec.fromarrays((variant[sent], hot), dtype="<u8,u1")
        yield from X.deal(number, n_slices, key[sent], doc[sent], pos[sent], ids, "<u8", more, windows[sent])


def judge_snippets(ids: np.ndarray, pos: np.ndarray, keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Later copies of a snippet repeat; the earliest copies are compared if their anchor has several snippets."""
    more = np.concatenate([np.frombuffer(m, "<u8,u1") for m in rows["more"]])
    variant, hot = more["f0"], more["f1"] > 0
    order = np.lexsort((pos, ids, variant, keys))
    k, v = keys[order], variant[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], v[1:] != v[:-1]))
    group = np.cumsum(new_key) - 1
    distinct = np.bincount(group[new])
    crowd = (distinct > HOT_SLICE) | (np.bincount(group, weights=hot[order]) > 0)
    first_says = np.where(crowd, X.BY_WINDOW, np.where(distinct > 1, X.COMPARE, X.OPEN))
    said = np.full(len(keys), X.OPEN)
    said[order] = np.where(new, first_says[group], X.REPEAT)
    return said


def entries_by_doc(answers: DataFrame, verdict: int) -> DataFrame:
    """(id, picks): the entries with that verdict as (start, windows, key) records for each document."""

    def flat(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = X.entry_ids(r.docs, r.counts)
                pos = X.unplanes(r.pos, "<u4")
                key = np.frombuffer(r.key, "<u8") if r.key else np.zeros(len(pos), np.uint64)
                picks = np.rec.fromarrays((pos, X.sizes_of(r.size, len(pos)), key), dtype="<u4,<u4,<u8")
                cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
                ends = np.append(cuts[1:], len(ids))
                yield pd.DataFrame({"id": ids[cuts], "picks": [picks[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})

    found = answers.where(F.col("verdict") == verdict).select("docs", "counts", "pos", "size", "key").mapInPandas(flat, "id long, picks binary")
    return found.groupBy("id").agg(F.unhex(F.array_join(F.collect_list(F.hex("picks")), "")).alias("picks"))


def cut_snippets(batches, length: int, n_slices: int):
    """mapInArrow, step 2: (id, text, picks) to SNIPPETS."""
    for batch in batches:
        ids, texts, picks = (batch.column(i).to_pylist() for i in range(3))
        cols: list[list] = [[] for _ in _ARROW]
        for i, text, pick in zip(ids, texts, picks, strict=True):
            data = (text or "").encode()
            for start, windows, key in np.unique(np.frombuffer(pick, "<u4,<u4,<u8")).tolist():
                row = ((key >> 32) % n_slices, key - (1 << 64) if key >> 63 else key, i, start, windows, data[start : start + windows - 1 + length])
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def dense_rank(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, given an order that sorts them."""
    new = np.concatenate(([False], x[order][1:] != x[order][:-1]))
    number = np.cumsum(new, dtype=np.int32)
    rank = np.empty(len(x), np.uint16 if number[-1] < 1 << 16 else np.uint32)
    rank[order] = number
    return rank


def moved(at: np.ndarray, base: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Positions n further (or back, if negative) in the same string, going round."""
    to = at + n
    out = to >= end if n > 0 else to < base
    to[out] = base[out] + (to[out] - base[out]) % (end[out] - base[out])
    return to


def leading(data: np.ndarray, base: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The n <= 8 bytes of each rotation's beginning as one number."""
    out, have, at = data.astype(np.uint64), 1, np.arange(len(data))
    while have < n:
        step = min(have, n - have)
        ahead = out[moved(at, base, end, have)] >> np.uint64(8 * (have - step))
        out = (out << np.uint64(8 * step)) | ahead
        have += step
    return out


def rotation_order(rank: np.ndarray, have: int, base: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Rotations of the strings in a shard, sorted by `length` bytes at least; rank sorts them by `have` bytes."""
    at = np.arange(len(rank))
    while True:
        order = np.argsort(rank, kind="stable")
        if have >= length or rank[order[-1]] == len(rank) - 1:
            return order
        ahead = rank[moved(at, base, end, have)]
        order = np.argsort(ahead, kind="stable")
        order = order[np.argsort(rank[order], kind="stable")]
        rank = dense_rank((rank.astype(np.uint64) << np.uint64(32)) | ahead, order)
        have *= 2


def merged_blocks(data: np.ndarray, lengths: np.ndarray, length: int, shard: int = SHARD) -> np.ndarray:
    """For each byte of the strings in data the number of its block: rotations with the same first `length` bytes.

    Every shard has its sorted rotations and, as its transform, the STEP symbols in front of each.  The interleave
    begins in shard order with one block.  A pass deals its elements by those symbols, in the order in which they
    stand; elements that come from one block with the same symbols form a block of the new interleave.
    """
    ends = np.cumsum(lengths)
    base, end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= shard or e == len(data):
            cuts.append(e)
    step = min(STEP, length, int(lengths.min()))
    ranks = {}
    for n in {step, length % step or step}:
        lead = leading(data, base, end, n)
        ranks[n] = dense_rank(lead, np.argsort(lead))
    suffix = np.empty(len(data), np.int64)  # shard by shard, each sorted
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = ranks[step][a:b]
        suffix[a:b] = a + rotation_order(dense_rank(own, np.argsort(own, kind="stable")), step, base[a:b] - a, end[a:b] - a, length)
    transform = {n: rank[moved(suffix, base[suffix], end[suffix], -n)] for n, rank in ranks.items()}
    shards = len(cuts) - 1
    interleave = np.repeat(np.arange(shards, dtype=np.uint8 if shards < 257 else np.uint32), np.diff(cuts))
    block, done = np.zeros(len(data), np.int32), 0
    while done < length:
        n = length % step or step if not done else step
        here = np.empty(len(data), transform[n].dtype)
        here[np.argsort(interleave, kind="stable")] = transform[n]  # shards keep their own order
        order = np.argsort(here, kind="stable")
        interleave, block, here = interleave[order], block[order], here[order]
        new = (here[1:] != here[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(new, out=block[1:])
        done += n
    out = np.empty(len(data), np.int32)
    out[suffix] = block[np.argsort(interleave, kind="stable")]
    return out


def repeats_by_transform(length: int):
    """applyInPandas, step 2: the snippets of a slice to RUNS of windows that also start earlier."""

    def one_pack(pack: pd.DataFrame):
        lengths = pack["data"].map(len).to_numpy()
        data = np.frombuffer(b"".join(pack["data"]), np.uint8)
        block = merged_blocks(data, lengths, length)
        windows = pack["windows"].to_numpy().astype(np.int64)
        place = ranges(np.cumsum(lengths) - lengths, windows)
        of = np.repeat(np.arange(len(pack)), windows)
        ids, pos = pack["id"].to_numpy()[of], pack["start"].to_numpy().astype(np.int64)[of] + ranges(np.zeros(len(pack), np.int64), windows)
        own = block[place]
        order = np.lexsort((pos, ids, own))
        late = order[np.concatenate(([False], own[order][1:] == own[order][:-1]))]
        return ids[late], pos[late]

    def one_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        size = pdf["data"].map(len).to_numpy()
        last_of_key = np.append(pdf["key"].to_numpy()[1:] != pdf["key"].to_numpy()[:-1], True)
        found, first, total = [], 0, 0
        for i in range(len(pdf)):
            total += size[i]
            if last_of_key[i] and (total >= PACK or i == len(pdf) - 1):
                found.append(one_pack(pdf.iloc[first : i + 1]))
                first, total = i + 1, 0
        ids, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        return X.union_runs(ids, pos, np.ones(len(pos), np.int64)) if len(ids) else pd.DataFrame({"id": np.zeros(0, np.int64), "runs": []})

    return one_slice


def deal_windows(batches, length: int, n_slices: int):
    """mapInArrow, step 3: (id, text, picks) to exchange rows; an entry is the hash of one window."""

    def parts():
        for batch in batches:
            ids, picks = np.asarray(batch.column(0)), batch.column(2).to_pylist()
            for first, data, offsets in text_chunks(batch.column(1)):
                own = [np.unique(np.frombuffer(p, "<u4,<u4,<u8")) for p in picks[first : first + len(offsets) - 1]]
                doc = np.repeat(np.arange(len(own)), [int(p["f1"].sum()) for p in own])
                pos = np.concatenate([ranges(p["f0"].astype(np.int64), p["f1"].astype(np.int64)) for p in own])
                where = offsets[:-1][doc] + pos
                key, check = range_digests(data, where, where + length)
                yield ids[first : first + len(own)], doc, pos, key, check

    for seq, (ids, doc, pos, key, check) in enumerate(X.gathered(parts(), X.BATCH // 2)):
        number = X.batch_number(seq)
        order = np.lexsort((pos, ids[doc], check, key))
        again = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])))[: len(key)]
        late, rest = np.sort(order[again]), np.sort(order[~again])
        yield from X.settled(number, n_slices, doc[late], pos[late], ids)
        yield from X.deal(number, n_slices, key[rest], doc[rest], pos[rest], ids, "<u8", check[rest])


def judge_windows(ids: np.ndarray, pos: np.ndarray, keys: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """All but the earliest copy of a window repeat."""
    check = np.concatenate([np.frombuffer(m, "<u8") for m in rows["more"]])
    order = np.lexsort((pos, ids, check, keys))
    again = np.concatenate(([False], (keys[order][1:] == keys[order][:-1]) & (check[order][1:] == check[order][:-1])))
    said = np.full(len(keys), X.OPEN)
    said[order] = np.where(again, X.REPEAT, X.OPEN)
    return said


def repeated_strings(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs): for documents that have any, runs (start, length) of byte positions where a repeated window starts."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    n = X.n_slices(texts)
    said = stash(X.answers(texts.mapInArrow(lambda it: X.to_arrow(deal_snippets(it, length, n)), X.ROWS), judge_snippets, "<u8"), folder, "snippets")
    release(spark)
    copies = said.where(F.col("verdict") == X.REPEAT).groupBy("batch").applyInPandas(X.batch_runs, X.RUNS)
    near = texts.join(entries_by_doc(said, X.COMPARE), "id")
    cut = near.mapInArrow(lambda it: cut_snippets(it, length, n), SNIPPETS)
    found = copies.unionByName(cut.groupBy("slice").applyInPandas(repeats_by_transform(length), X.RUNS))
    if not said.where(F.col("verdict") == X.BY_WINDOW).isEmpty():
        crowd = texts.join(entries_by_doc(said, X.BY_WINDOW), "id")
        rows = crowd.mapInArrow(lambda it: X.to_arrow(deal_windows(it, length, n)), X.ROWS)
        found = found.unionByName(X.settle(rows, judge_windows, "<u8"))
        del crowd, rows
    repeats = stash(found, folder, "repeats")
    del said, copies, near, cut, found
    release(spark)
    forget(spark, f"{folder}/snippets")
    return repeats


STRIPPED = "n_bytes long, n_removed long, removed_spans array<struct<first:int,last:int>>, kept_bytes binary"


def strip(text: pd.Series, runs: pd.Series, length: int) -> pd.DataFrame:
    """STRIPPED for each text and its runs of repeated windows."""
    out = []
    for t, r in zip(text, runs, strict=True):
        data = t.encode() if isinstance(t, str) else b""
        if not r:
            out.append((len(data), 0, [], data))
            continue
        gone = X.run_cover(r, len(data), more=length - 1)
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), [{"first": int(a), "last": int(b)} for a, b in edge], kept))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "removed_spans", "kept_bytes"])


def suffix_dedup(docs: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_bytes, n_removed, removed_spans (byte ranges, last excluded) and kept_bytes.

    kept_bytes may cut a character in two, as strings are bytes.  Null and empty texts have no bytes; shorter texts
    than `length` keep all.  A null id sorts before all others.  Rows that repeat an id and text each get the marks of
    all rows of that id.  Texts are read whole.  Columns of docs keep their names; those named like a result column
    are replaced.
    """
    docs = docs.drop(*RESULT)
    found = X.whole_runs(repeated_strings(docs, length=length, id_col=id_col, text_col=text_col))

    @F.pandas_udf(STRIPPED)
    def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return strip(text, runs, length)

    key, runs, out = fresh(docs, "key", "runs", "out")
    rows = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).join(found.toDF(key, runs), key, "left")
    return rows.withColumn(out, cut(F.col(text_col), F.col(runs))).select(*docs.columns, f"{out}.*")


def op3(spark, sf_dir: str) -> DataFrame:
    """op3_suffix_dedup: one row per document."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, q, substring(h, 2 * q + 1, 2 * 611) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 512)) AS q FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, q + o AS p, md5(substring(part, 2 * o + 1, 200)) AS k FROM (SELECT *, unnest(range(length(part) // 2 - 99)) AS o FROM q)),
f AS (SELECT k, min({'i': doc_id, 'p': p}) AS f FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE (doc_id, p) <> (f.i, f.p)),
b AS (SELECT doc_id, unnest(range(length(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS x FROM d),
c AS (SELECT doc_id, b.p, x, max(m.p IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM b LEFT JOIN m USING (doc_id, p)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def brute_force(docs: list[tuple], length: int = 100) -> list[tuple]:
    """The contract, byte for byte, for small inputs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: set[bytes] = set()
    out = []
    for i, t in sorted(docs, key=lambda d: d[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
