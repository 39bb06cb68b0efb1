"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Every task tokenizes its documents.  Their pieces are dealt by hash, so that every packer sees the mix of lengths, and
packed longest first, each into the fullest sequence that has room.  Sequences that are nearly full are done.  The others move up a tree as items of their fill: each node
takes the underfull sequences of `fan_in` nodes below and packs them by best fit again, up to the root.
After best fit at most one sequence of a node is half full or less, as two such would have been one; only these look for
room in others.  So nodes on a level, as many as they are, leave no more than that many to be placed, and each hands up
its emptiest sequences in that number (`carry` at least): what stays is never needed, and the root's work is bounded.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import shared_dir, stash

LENGTHS = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = LENGTHS + ", bin long, offset long"


@cache
def encoder(path: str):
    """text -> ids of the byte-level BPE vocabulary at `path`.  The .tiktoken form of byte_bpe_50k.json holds the same
    vocabulary but for the added tokens, which come from the json file beside it, and gives the same ids three times
    as fast.  Strings of added tokens in a text are these tokens.  Its pattern can't pass about a million spaces or line
    ends in a row; such texts take the json file's own tokenizer."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        known = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def encode(text: str) -> list[int]:
            try:
                return known.encode(text, allowed_special="all")
            except ValueError:  # of the pattern, as no special token is forbidden
                return encoder(path.removesuffix(".tiktoken") + ".json")(text)

        return encode
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def cut(n: int, size: int):
    """(start, length) of the pieces of n ids: the first takes the remainder, so that all others are full."""
    first = n if n <= size else n % size or size
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.  Longest items first, each into the bin with the least
    room that suffices; rooms that some bin has are the set bits of one number."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, size - room
        fills[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, np.array(fills, np.int64)


def tokenize(batches, path: str, size: int):
    """mapInPandas: (doc_id, text) to LENGTHS."""
    encode = encoder(path)
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            ids = np.array([*encode(text or ""), 0], dtype="<u4")
            for k, (start, length) in enumerate(cut(len(ids), size)):
                rows.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def pack_locally(batches, size: int):
    """mapInPandas: LENGTHS to PIECES, packed within this task; bin numbers are unique over all tasks."""
    held = [pdf.astype({"doc_id": "Int64"}) for pdf in batches if len(pdf)]
    if held:
        out = pd.concat(held, ignore_index=True).sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins, out["offset"], _ = best_fit(out["length"].to_numpy(), size)
        out["bin"] = (TaskContext.get().partitionId() << 32) + bins
        yield out[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]]


def node_merger(level: int, size: int, slack: int, carry: int):
    """Best fit of one node's underfull bins: (bin, into, shift, fill, node, open); open bins move on."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        bins, offsets, fills = best_fit(pdf["fill"].to_numpy(), size)
        base = (level << 56) + (int(pdf["node"].iloc[0]) << 28)
        is_open = fills < size - slack
        if is_open.sum() > carry:
            is_open &= np.isin(np.arange(len(fills)), np.argsort(fills, kind="stable")[:carry])
        return pd.DataFrame({"bin": pdf["bin"], "into": base + bins, "shift": offsets, "fill": fills[bins], "node": pdf["node"], "open": is_open[bins]})

    return merge


def pack(docs: DataFrame, *, size: int = 2048, slack: int = 8, fan_in: int = 16, carry: int = 50_000, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies.

    A document is the ids of its text and then id 0; null and empty texts are that one id.  Only documents of more
    than `size` ids are cut; their first piece takes the remainder.  Repeated rows are packed once each; a null id
    stays null; other columns aren't read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks = max(1, texts.rdd.getNumPartitions())
    lengths = texts.mapInPandas(lambda it: tokenize(it, path, size), LENGTHS).repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32"))
    pieces = stash(lengths.mapInPandas(lambda it: pack_locally(it, size), PIECES), folder, "pieces")
    fills = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < size - slack)
    level, moved = 0, None
    under = fills.select("bin", "fill", F.shiftright("bin", 32).alias("node"))
    while level == 0 or tasks > 1:
        level += 1
        tasks = -(-tasks // fan_in)
        nodes = under.withColumn("node", F.expr(f"node div {fan_in}"))
        merged = stash(nodes.groupBy("node").applyInPandas(node_merger(level, size, slack, max(carry, tasks)), "bin long, into long, shift long, fill long, node long, open boolean"), folder, f"level{level}")
        step = merged.select("bin", "into", "shift")
        if moved is None:
            moved = step
        else:
            up = step.select(F.col("bin").alias("into"), F.col("into").alias("higher"), F.col("shift").alias("more"))
            moved = moved.join(up, "into", "left").select("bin", F.coalesce("higher", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        under = merged.where("open").select(F.col("into").alias("bin"), "fill", "node").distinct()
    placed = pieces.join(moved, "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op10(spark, sf_dir: str) -> DataFrame:
    """op10_packing: one row per piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
