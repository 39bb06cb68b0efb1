"""WARC archives as seekable Zstandard bundles.

Pages are written as WARC records.  Records are grouped into frames, each an independent Zstandard frame; a bundle is
a file of frames that ends in a seek table (a skippable frame with every frame's sizes).  The index maps record
identifiers to bundle, frame and the offset within the frame, so one record is read by unpacking one frame.
Of equal payloads one page holds the payload (response); the others refer to it (revisit).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import shared_dir, stash

#: Fixed values of the seekable format: magic numbers of the skippable frame and of the table's footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, offset long, size long"
#: Frames that are read as one piece of work, and most tasks that read.
FRAMES, MAX_TASKS = 128, 100_000
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def opened(uri: str):
    """File system and path of a URI; any store that pyarrow.fs knows, with Hadoop's names of S3 too."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def page_of(record: str | None) -> int | None:
    tail = (record or "").rpartition(":")[2]
    return int(tail) if tail else None


def to_record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the response's HTTP header, with the full length, and no body."""
    kind = "revisit" if revisits else "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Record-ID: <{record_id(page_id)}>"]
    if revisits:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at `at`, checked against its digest, and where the next one begins."""
    head_end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:head_end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    start = head_end + 4
    end = start + int(head["content-length"])
    block = data[start:end]
    http_end = block.index(b"\r\n\r\n") + 4
    payload = block[http_end:] if head["warc-type"] == "response" else None
    said = head["warc-payload-digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", block[:http_end])[1])
    if payload is not None and (digest(payload) != said or len(payload) != length):
        raise ValueError(f"record {head['warc-record-id']} is damaged")
    return {"page_id": page_of(head["warc-record-id"].strip("<>")), "url": head["warc-target-uri"], "record_type": head["warc-type"], "payload_digest": said, "payload_bytes": length, "refers_to": page_of(head.get("warc-refers-to", "").strip("<>")), "payload": payload}, end + 4


class BundleWriter:
    """Gathers records to frames and frames to bundles below `folder`; close() writes what is left.

    A bundle has a new name each time, so an attempt that fails leaves files that no index row names.
    """

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frame, self.frames, self.sizes, self.rows, self.done = bytearray(), [], [], [], []
        self._name()

    def _name(self):
        self.bundle = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"

    def add(self, page_id: int | None, kind: str, record: bytes):
        if self.frame and len(self.frame) + len(record) > self.frame_bytes:
            self._end_frame()
        self.rows.append((page_id, record_id(page_id), kind, self.bundle, len(self.frames), len(self.frame), len(record)))
        self.frame += record

    def _end_frame(self):
        packed = self.pack(bytes(self.frame))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.frame = bytearray()
        if sum(len(f) for f in self.frames) >= self.bundle_bytes:
            self._end_bundle()

    def _end_bundle(self):
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        store, path = opened(self.bundle)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path, compression=None) as out:
            for f in self.frames:
                out.write(f)
            out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.done += self.rows
        self.frames, self.sizes, self.rows = [], [], []
        self._name()

    def close(self):
        if self.frame:
            self._end_frame()
        if self.frames:
            self._end_bundle()

    def index(self) -> pd.DataFrame:
        """Index rows of the bundles that are written, once each."""
        rows, self.done = self.done, []
        out = pd.DataFrame(rows, columns=["page_id", "record_id", "record_type", "bundle", "frame", "offset", "size"])
        return out.astype({"page_id": "Int64"})


def seek_table(file) -> list[tuple[int, int]]:
    """(where, packed size) of each frame of an open bundle, from its footer."""
    end = file.size()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    sizes, at, out = struct.unpack(f"<{2 * n}I", file.read(8 * n)), 0, []
    for packed in sizes[::2]:
        out.append((at, packed))
        at += packed
    return out


def read_frame(file, where: int, packed: int) -> bytes:
    file.seek(where)
    return zstandard.ZstdDecompressor().decompress(file.read(packed))


def write_bundles(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 26, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages as bundles below `folder`/bundles and return the index (INDEX), itself written to `folder`/index.

    Of pages with equal payloads of at least min_revisit_bytes that with the largest id is the response; the others
    are revisits.  Null payloads are empty; a null id is smaller than others; rows that repeat id and payload share the
    verdict; an empty table gives an empty index.  Control characters in URLs are percent-encoded.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    holders = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(holders, "sha", "left").select("id", "url", "payload", "holder")

    def write(batches):
        out = BundleWriter(f"{folder}/bundles", frame_bytes, bundle_bytes, level)
        for pdf in batches:
            for page_id, url, payload, holder in pdf.astype({"id": "Int64", "holder": "Int64"}).itertuples(index=False):
                page_id, holder = (None if pd.isna(x) else int(x) for x in (page_id, holder))
                revisits = holder is not None and holder != page_id
                out.add(page_id, "revisit" if revisits else "response", to_record(page_id, url, bytes(payload), revisits, holder, date))
            yield out.index()
        out.close()
        yield out.index()

    return stash(joined.mapInPandas(write, INDEX), folder, "index")


def read_bundles(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """RECORDS of the bundles that the index names, read frame by frame and checked against their digests.  A task reads
    some FRAMES frames of a bundle, whose places the seek table tells."""
    parts = index.select("bundle", F.expr(f"frame div {FRAMES}").alias("part")).distinct()
    tasks = min(MAX_TASKS, max(1, parts.count()))

    def read(batches):
        for pdf in batches:
            for uri, part in zip(pdf["bundle"], pdf["part"], strict=True):
                store, path = opened(uri)
                with store.open_input_file(path) as file:
                    for where, packed in seek_table(file)[part * FRAMES : (part + 1) * FRAMES]:
                        data, at, rows = read_frame(file, where, packed), 0, []
                        while at < len(data):
                            record, at = parse_record(data, at)
                            rows.append(record)
                        out = pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})
                        yield out if payloads else out.assign(payload=None)

    return parts.repartition(tasks).mapInPandas(read, RECORDS)


def fetch(index: DataFrame, wanted: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """RECORDS of the wanted ids only: opens their bundles, unpacks their frames and reads at their offsets."""
    rows = index.join(wanted.select(F.col(id_col).cast("long").alias("page_id")).distinct(), "page_id", "left_semi")

    def read(batches):
        for pdf in batches:
            for uri, own in pdf.groupby("bundle"):
                store, path = opened(uri)
                with store.open_input_file(path) as file:
                    table = seek_table(file)
                    for frame, part in own.groupby("frame"):
                        data = read_frame(file, *table[frame])
                        yield pd.DataFrame([parse_record(data, at)[0] for at in part["offset"]]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return rows.select("bundle", "frame", "offset").mapInPandas(read, RECORDS)


def op5(spark, sf_dir: str) -> DataFrame:
    """op5_warc: one row per page, from the archives read back."""
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    return read_bundles(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substring(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), 'string_agg', '') AS payload_digest FROM d),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM l
"""


def brute_force(pages: list[tuple]) -> list[tuple]:
    """The contract for small inputs of (page_id, html)."""
    holder: dict[bytes, int] = {}
    data = [(i, (h or "").encode()) for i, h in pages]
    for i, p in data:
        holder[p] = max(holder.get(p, i), i)
    return [(i, len(p), digest(p), "response" if holder[p] == i else "revisit", None if holder[p] == i else holder[p]) for i, p in data]
