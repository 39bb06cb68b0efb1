"""AVI files as a data source, against files that are built here frame by frame."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import frames
from lumenfold.sources import video

SIZE = (18, 21)  # rows and columns; rows of 63 bytes are padded to 64


def pictures(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (3, *SIZE, 3), np.uint8)
    return [np.roll(base[3 * k // n], k, axis=1) for k in range(n)]


def chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def named(kind, data):
    return chunk(b"LIST", kind + data)


def raw(picture, upward=True):
    rows = np.pad(picture.reshape(SIZE[0], -1), ((0, 0), (0, 1)))
    return (rows[::-1] if upward else rows).tobytes()


def avi(bodies, *, code=b"\0\0\0\0", index="relative", upward=True, parts=1, groups=False):
    """An AVI file of an audio and a video stream at 25 frames a second."""
    height = SIZE[0] if upward else -SIZE[0]
    strh = lambda kind: chunk(b"strh", kind + code + struct.pack("<IHHIIII", 0, 0, 0, 0, 1, 25, 0) + bytes(24))
    form = chunk(b"strf", struct.pack("<IiiHH4sIiiII", 40, SIZE[1], height, 1, 24, code, 0, 0, 0, 0, 0))
    hdrl = named(b"hdrl", chunk(b"avih", bytes(56)) + named(b"strl", strh(b"auds") + chunk(b"strf", bytes(18))) + named(b"strl", strh(b"vids") + form))
    out, each = b"", -(-len(bodies) // parts)
    for p in range(parts):
        data, entries = b"", b""
        start = 4 + (8 + 4 + len(hdrl) + 8 if index == "absolute" else 0)
        for body in bodies[p * each : (p + 1) * each]:
            for name, content in ((b"00wb", b"sound"), (b"01dc", body)):
                one = chunk(name, content)
                entries += name + struct.pack("<III", 16, start + len(data), len(content))
                data += named(b"rec ", one) if groups else one
        riff = (b"AVI " + hdrl if p == 0 else b"AVIX") + named(b"movi", data) + (chunk(b"idx1", entries) if index and p == 0 else b"")
        out += chunk(b"RIFF", riff)
    return out


def rows(df):
    return sorted((r["frame_idx"], round(r["ts"], 6), r["codec"], bytes(r["content"] or b"")) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"index": "absolute"}, {"index": None}, {"upward": False}, {"parts": 3}, {"index": None, "groups": True}])
def test_frames_of_split_files(spark, tmp_path, how):
    """Many partitions of one file give the frames of one, whatever the file's layout."""
    shown = pictures(30)
    (tmp_path / "a.AVI").write_bytes(avi([raw(p, how.get("upward", True)) for p in shown], **how))
    want = [(k, round(k / 25, 6), "bgr24", p.tobytes()) for k, p in enumerate(shown)]
    one, many = video.frames_of(spark, str(tmp_path)), video.frames_of(spark, f"file://{tmp_path}/a.AVI", split_bytes=4000)
    assert rows(one) == want and rows(many) == want
    assert many.rdd.getNumPartitions() > 5 and many.select("video").distinct().collect() == one.select("video").distinct().collect()


def test_compressed_repeated_and_broken(spark, tmp_path):
    """JPEG data stays as it is, empty chunks are null, cut files give what they have, other files nothing."""
    bodies = [b"\xff\xd8 first \xff\xd9", b"", b"\xff\xd8 odd\xff\xd9"]
    whole = avi(bodies, code=b"MJPG")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "m.avi").write_bytes(whole)
    (tmp_path / "cut.avi").write_bytes(avi(bodies, code=b"MJPG", index=None)[:-9])
    (tmp_path / "text.avi").write_bytes(b"no video")
    (tmp_path / "empty.avi").write_bytes(b"")
    (tmp_path / "head.avi").write_bytes(whole[:100])
    (tmp_path / "m.txt").write_bytes(whole)
    got = video.frames_of(spark, str(tmp_path))
    files = {name: rows(got.where(F.col("video").endswith(name))) for name in ("m.avi", "cut.avi")}
    assert [r[2:] for r in files["m.avi"]] == [("MJPG", b) for b in bodies]
    assert [r[3] for r in files["cut.avi"]] == bodies[:2] and got.count() == 5
    assert got.where("content is null").count() == 2 and got.where(video.picture().isNotNull()).count() == 0
    assert video.frames_of(spark, str(tmp_path), recursive=False).count() == 2
    (tmp_path / "none").mkdir()
    assert video.frames_of(spark, str(tmp_path / "none")).count() == 0


def test_key_frames_of_files(spark, tmp_path):
    """Frames of two files feed the key-frame methods."""
    for k in range(2):
        (tmp_path / f"{k}.avi").write_bytes(avi([raw(p) for p in pictures(30, k)]))
    shots = video.frames_of(spark, str(tmp_path), split_bytes=8000).withColumn("image", video.picture()).drop("content")
    every = frames.extract(shots, "uniform", ["video"], ["frame_idx"], F.lit(0), every=10)
    assert sorted(r["frame_idx"] for r in every.collect()) == [0, 0, 10, 10, 20, 20]
    moved = frames.extract(shots, "motion", ["video"], ["frame_idx"], F.lit(0), threshold=0.0)
    assert {r["video"] for r in moved.where("motion is null").collect()} == {r["video"] for r in shots.select("video").distinct().collect()}
