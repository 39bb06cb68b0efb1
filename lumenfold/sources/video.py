"""Frames of AVI files as a Spark data source: byte ranges of files are partitions, tasks find their frames by the index."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenfold.operators.lifecycle import file_system

FRAMES = "video string, frame_idx long, ts double, width int, height int, codec string, content binary"
#: Bytes of a file that a partition covers, and bytes of frames that a batch holds before it is passed on.
SPLIT, BATCH = 64 << 20, 16 << 20
#: OpenCV's type of 8-bit pictures with three channels, as in Spark's image schema.
THREE_CHANNELS = 16


class NotVideo(ValueError):
    """A file that isn't an AVI file with a video stream."""


@dataclass
class Stream:
    """What the header tells about the first video stream, and where chunks of frames begin."""

    chunk: bytes
    seconds: float
    width: int
    height: int
    codec: str
    upward: bool
    movi: int
    end: int


def chunks(file, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of the chunks between two places; a chunk that is cut off ends them."""
    while at + 8 <= end:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if at + 8 + size > end and name not in (b"RIFF", b"LIST"):
            return
        yield name, at + 8, size
        at += 8 + size + size % 2


def part(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


def header(file, length: int) -> Stream:
    if length < 12 or part(file, 0, 4) != b"RIFF" or part(file, 8, 4) != b"AVI ":
        raise NotVideo
    first, movi = None, None
    for name, at, size in chunks(file, 12, length):
        kind = part(file, at, 4) if name == b"LIST" else b""
        if kind == b"hdrl":
            lists = [(a, n) for c, a, n in chunks(file, at + 4, min(at + size, length)) if c == b"LIST" and part(file, a, 4) == b"strl"]
            for number, (a, n) in enumerate(lists):
                inner = {c: part(file, p, k) for c, p, k in chunks(file, a + 4, min(a + n, length))}
                head, form = inner.get(b"strh", b""), inner.get(b"strf", b"")
                if first is None and head[:4] == b"vids" and len(head) >= 28 and len(form) >= 20:
                    first = (number, head, form)
        elif kind == b"movi":
            movi = (at + 4, min(at + size, length))
            break
    if first is None or movi is None:
        raise NotVideo
    number, head, form = first
    scale, rate = struct.unpack_from("<II", head, 20)
    width, height, _, bits, code = struct.unpack_from("<iiHH4s", form, 4)
    raw = code in (b"\0\0\0\0", b"DIB ")
    codec = ("bgr24" if bits == 24 else f"rgb{bits}") if raw else code.decode("latin-1").strip()
    return Stream(b"%02d" % number, scale / rate if rate else 0.0, width, abs(height), codec, height > 0, *movi)


def places(file, length: int, stream: Stream, until: int) -> np.ndarray:
    """(first byte, size) of the stream's frames in order.  The index at the end of the file gives them in one read;
    without one, and in files of several parts, headers are read one after the other as far as `until`."""
    whole = True
    for name, at, size in chunks(file, stream.end + stream.end % 2, length):
        if name == b"RIFF":
            whole = False
        if name == b"idx1" and whole and part(file, at + size + size % 2, 4) != b"RIFF":
            entries = np.frombuffer(part(file, at, size // 16 * 16), np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
            entries = entries[np.isin(entries["name"], [stream.chunk + b"dc", stream.chunk + b"db"])]
            if len(entries):
                found = np.stack((entries["at"].astype(np.int64) + 8, entries["size"].astype(np.int64)), axis=1)
                if part(file, int(found[0, 0]) - 8, 4) != entries["name"][0]:  # offsets count from the list's name
                    found[:, 0] += stream.movi - 4
                return found[found.sum(axis=1) <= length]
    return np.array(list(walk(file, stream, stream.movi, length, until)), np.int64).reshape(-1, 2)


def walk(file, stream: Stream, at: int, end: int, until: int) -> Iterator[tuple[int, int]]:
    for name, a, size in chunks(file, at, end):
        if a > until:
            return
        if name in (b"RIFF", b"LIST"):  # further parts, and groups of chunks
            yield from walk(file, stream, a + 4, min(a + size, end), until)
        elif name in (stream.chunk + b"dc", stream.chunk + b"db"):
            yield a, size


def upright(data: bytes, stream: Stream) -> bytes:
    """Rows of an uncompressed picture from the top, without padding; data of another size stays as it is."""
    line = (stream.width * 3 + 3) // 4 * 4
    if stream.codec != "bgr24" or len(data) != line * stream.height:
        return data
    rows = np.frombuffer(data, np.uint8).reshape(stream.height, line)[:, : stream.width * 3]
    return (rows[::-1] if stream.upward else rows).tobytes()


@dataclass
class Range(InputPartition):
    """The bytes of a file in which a partition's frames begin."""

    video: str
    length: int
    start: int
    end: int


class AviReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT))
        self.deep = options.get("recursivefilelookup", "true").lower() == "true"

    def partitions(self):
        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path, recursive=self.deep)) if info.type == fs.FileType.Directory else [info]
        head = self.path[: self.path.index(path.rstrip("/"))] if "://" in self.path else "file://"  # scheme and host
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".avi"))
        out = [Range(head + name, size, a, min(a + self.split, size)) for name, size in files for a in range(0, size, self.split)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.video:
            return
        system, path = file_system(partition.video)
        with system.open_input_file(path) as file:
            try:
                stream = header(file, partition.length)
            except NotVideo:
                return
            found = places(file, partition.length, stream, partition.end)
            mine = np.flatnonzero((found[:, 0] >= partition.start) & (found[:, 0] < partition.end))
            held, number, size = [], [], 0
            for k in mine.tolist():
                data = part(file, *found[k].tolist())
                held.append(upright(data, stream) if data else None)
                number.append(k)
                size += len(data)
                if size >= BATCH:
                    yield batch(partition.video, stream, number, held)
                    held, number, size = [], [], 0
            if held:
                yield batch(partition.video, stream, number, held)


def batch(video: str, stream: Stream, number: list[int], held: list[bytes | None]) -> pa.RecordBatch:
    n = len(held)
    columns = [pa.array([video] * n), pa.array(number, pa.int64()), pa.array([k * stream.seconds for k in number]), pa.array([stream.width] * n, pa.int32()), pa.array([stream.height] * n, pa.int32()), pa.array([stream.codec] * n), pa.array(held, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["video", "frame_idx", "ts", "width", "height", "codec", "content"])


class AviFrames(DataSource):
    """spark.read.format("avi_frames").load(path); options splitBytes and recursiveFileLookup."""

    @classmethod
    def name(cls):
        return "avi_frames"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return AviReader({k.lower(): v for k, v in self.options.items()})


def frames_of(spark: SparkSession, path: str, *, split_bytes: int = SPLIT, recursive: bool = True) -> DataFrame:
    """(video, frame_idx, ts, width, height, codec, content) of the AVI files at a path or below a folder.

    Codec is the stream's name (MJPG: content is a JPEG file) or bgr24, where content has the rows from the top.  A null
    content repeats the frame before.  Files that aren't AVI give no rows, files that are cut off the frames they have.
    The driver lists files only; a task reads the header, the index and the frames that begin in its bytes.
    """
    spark.dataSource.register(AviFrames)
    return spark.read.format("avi_frames").option("splitBytes", split_bytes).option("recursiveFileLookup", str(recursive).lower()).load(path)


def picture() -> Column:
    """The image struct of a frame in bgr24, null for other codecs and repeated frames."""
    plain = (F.col("codec") == "bgr24") & (F.length("content") == F.col("width") * F.col("height") * 3)
    return F.when(plain, F.struct(F.col("video").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), F.lit(THREE_CHANNELS).alias("mode"), F.col("content").alias("data")))
