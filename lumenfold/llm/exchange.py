"""Packed exchange: positions of many documents travel by hash slice as binary arrays, not as a row each.

A task gathers some millions of positions (a batch), keeps what one batch can settle by itself - copies of a key
inside a batch never leave it - and deals the rest to slices by key.  Slices are as many as the bytes of all texts ask
for, so a slice has a bounded size.  A slice's task settles its keys and
answers by batch; a batch's answers are put together to runs of positions for each document.  So a key that
a third of all documents share costs each batch one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import slices
from lumenfold.llm.textnp import cover

#: Positions that a batch gathers before it is dealt.
BATCH = 2_000_000
#: Bytes of text that a hash slice stands for: few while the input is small, never more than the second number.
SLICE_BYTES = (1 << 22, 1 << 25)
#: verdict is OPEN for entries that their slice has to judge; answers keep the other verdicts.
ROWS = "slice int, batch long, verdict int, docs binary, counts binary, pos binary, size binary, key binary, more binary"
OPEN, REPEAT, COMPARE, BY_WINDOW = 0, 1, 2, 3
_ARROW = pa.schema([("slice", pa.int32()), ("batch", pa.int64()), ("verdict", pa.int32()), *[(c, pa.binary()) for c in ("docs", "counts", "pos", "size", "key", "more")]])
ANSWERS = "batch long, verdict int, docs binary, counts binary, pos binary, size binary, key binary"
RUNS = "id long, runs binary"


def planes(x: np.ndarray, dtype: str) -> bytes:
    """Numbers as one run of bytes for each byte of the number; the many zero bytes then compress."""
    x = np.ascontiguousarray(x, dtype)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def by_doc(doc: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids and counts of the runs of equal document numbers."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    return ids[doc[first]].astype("<i8").tobytes(), planes(np.diff(first, append=len(doc)), "<u4")


def deal(batch: int, n_slices: int, key: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, key_type: str, more: np.ndarray | None = None, size: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of one batch: entries go to the slice that the upper half of their key names."""
    if not len(key):
        return
    to = ((key >> np.uint64(32)) % np.uint64(n_slices)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    bounds = np.flatnonzero(np.diff(to[order], prepend=-1))
    for a, b in zip(bounds, np.append(bounds[1:], len(order)), strict=True):
        at = order[a:b]
        docs, counts = by_doc(doc[at], ids)
        yield int(to[at[0]]), batch, OPEN, docs, counts, planes(pos[at], "<u4"), b"" if size is None else planes(size[at], "<u4"), key[at].astype(key_type).tobytes(), b"" if more is None else more[at].tobytes()


def settled(batch: int, n_slices: int, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, size: np.ndarray | None = None, verdict: int = REPEAT) -> Iterator[tuple]:
    """The row for positions that the batch has settled itself."""
    if len(doc):
        yield batch % n_slices, batch, verdict, *by_doc(doc, ids), planes(pos, "<u4"), b"" if size is None else planes(size, "<u4"), b"", b""


def batch_number(seq: int) -> int:
    return (TaskContext.get().partitionId() << 24) + seq


def to_arrow(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _ARROW, strict=True)], schema=_ARROW)


def gathered(parts: Iterator[tuple], size: int = BATCH) -> Iterator[tuple]:
    """Joins (ids, doc, pos, *arrays) parts to batches of about `size` positions; doc counts from 0 in each part."""
    held, total, docs = [], 0, 0
    for ids, doc, *arrays in parts:
        held.append((ids, doc + docs, *arrays))
        total, docs = total + len(doc), docs + len(ids)
        if total >= size:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, total, docs = [], 0, 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def entry_ids(docs: bytes, counts: bytes) -> np.ndarray:
    """The document id of each entry of a row."""
    return np.repeat(np.frombuffer(docs, "<i8"), unplanes(counts, "<u4"))


def sizes_of(size: bytes, n: int) -> np.ndarray:
    return unplanes(size, "<u4").astype(np.int64) if size else np.ones(n, np.int64)


def answers(rows: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame], np.ndarray], key_type: str) -> DataFrame:
    """ANSWERS: what batches settled themselves, and open entries to which `judge` gives a verdict.

    judge gets the entries of a slice - document ids, positions, keys - and the slice's rows (for `more`)."""

    def one_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        done, todo = pdf[pdf["verdict"] != OPEN], pdf[pdf["verdict"] == OPEN].reset_index(drop=True)
        out = [tuple(r[1:8]) for r in done.itertuples(index=False)]
        if len(todo):
            n = np.array([len(p) // 4 for p in todo["pos"]])
            ids = np.concatenate([entry_ids(d, c) for d, c in zip(todo["docs"], todo["counts"], strict=True)])
            pos = np.concatenate([unplanes(p, "<u4") for p in todo["pos"]])
            keys = np.concatenate([np.frombuffer(k, key_type) for k in todo["key"]])
            said = judge(ids, pos, keys, todo)
            ends = np.cumsum(n)
            for batch, size, a, b in zip(todo["batch"], todo["size"], ends - n, ends, strict=True):
                size = unplanes(size, "<u4") if size else None
                for verdict in np.unique(said[a:b]):
                    if verdict != OPEN:
                        own = np.flatnonzero(said[a:b] == verdict)
                        at = ids[a:b][own]
                        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                        out.append((batch, int(verdict), at[first].tobytes(), planes(np.diff(first, append=len(at)), "<u4"), planes(pos[a:b][own], "<u4"), b"" if size is None else planes(size[own], "<u4"), keys[a:b][own].tobytes() if verdict == COMPARE else b""))
        return pd.DataFrame(out, columns=["batch", "verdict", "docs", "counts", "pos", "size", "key"])

    return rows.groupBy("slice").applyInPandas(one_slice, ANSWERS)


def union_runs(ids: np.ndarray, pos: np.ndarray, size: np.ndarray) -> pd.DataFrame:
    """RUNS: for each id the union of its ranges, as (start, length) pairs."""
    order = np.lexsort((pos, ids))
    ids, pos, end = ids[order], pos[order].astype(np.int64), (pos + size)[order].astype(np.int64)
    # ids become offsets so far apart that one running maximum serves all documents
    owner = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
    far = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + far)
    new = np.concatenate(([True], (pos + far)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(pos) - 1)
    runs = np.stack((pos[first], reach[last] - far[last] - pos[first]), axis=1).astype("<u4")
    cuts = np.flatnonzero(np.concatenate(([True], owner[first][1:] != owner[first][:-1])))
    ends = np.append(cuts[1:], len(first))
    return pd.DataFrame({"id": ids[first][cuts], "runs": [runs[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)]})


def batch_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """RUNS of the answers of one batch."""
    ids = np.concatenate([entry_ids(d, c) for d, c in zip(pdf["docs"], pdf["counts"], strict=True)])
    pos = [unplanes(p, "<u4") for p in pdf["pos"]]
    size = np.concatenate([sizes_of(s, len(p)) for s, p in zip(pdf["size"], pos, strict=True)])
    return union_runs(ids, np.concatenate(pos).astype(np.int64), size)


def settle(rows: DataFrame, judge, key_type: str) -> DataFrame:
    """RUNS for the positions that batches settled themselves or that `judge` calls REPEAT."""
    return answers(rows, judge, key_type).groupBy("batch").applyInPandas(batch_runs, RUNS)


def whole_runs(found: DataFrame) -> DataFrame:
    """One row for each id, where answers of several batches or kinds may have left more."""
    return found.groupBy("id").agg(F.unhex(F.array_join(F.collect_list(F.hex("runs")), "")).alias("runs"))


def run_cover(runs: bytes | None, n: int, more: int = 0, before: int = 0) -> np.ndarray:
    """Which of n positions the runs cover, each drawn out by `more` behind and `before` in front."""
    if not runs:
        return np.zeros(n, bool)
    at = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64)
    start, end = np.maximum(at[:, 0] - before, 0), np.minimum(at[:, 0] + at[:, 1] + more, n)
    own = start < end
    return cover(n, start[own], (end - start)[own])


def n_slices(texts: DataFrame) -> int:
    """Number of hash slices for (id, text): it grows with the bytes of the texts, so that no slice - one group of one
    task - grows with the input."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least, most = SLICE_BYTES
    return max(slices(texts.sparkSession), -(-total // min(most, max(least, total // 4096))))
