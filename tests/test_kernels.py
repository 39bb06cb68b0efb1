"""Pixel kernels against closed forms."""

import numpy as np
import pixel_reference as R
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.functions import pixels as P
from lumenfold.sources import images as I

RNG = np.random.default_rng(3)
NOISE = RNG.integers(0, 256, (224, 224, 3), dtype=np.uint8)
FLAT = np.full((64, 48, 3), 90, np.uint8)


def test_decode():
    row = {"height": 2, "width": 3, "nChannels": 1, "data": bytes(range(6))}
    assert K.decode(row)[1, 0, 0] == 3
    assert K.decode({**row, "height": -1}) is None
    assert K.decode({**row, "data": b"123"}) is None
    assert K.decode(None) is None


@pytest.mark.parametrize("kernel", [R.phash, R.dhash, R.whash])
def test_hashes(kernel):
    assert kernel(NOISE) == kernel(NOISE.copy())
    near = np.clip(1.1 * NOISE.astype(float) + 10, 0, 255).astype(np.uint8)
    other = RNG.integers(0, 256, NOISE.shape, dtype=np.uint8)
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert bits(kernel(NOISE), kernel(near)) < bits(kernel(NOISE), kernel(other))
    assert -(2**63) <= kernel(NOISE) < 2**63


def test_dhash_of_gradient():
    ramp = np.tile(np.arange(90, dtype=np.uint8) * 2, (80, 1))
    assert R.dhash(ramp) == -1 and R.dhash(ramp[:, ::-1]) == 0
    assert R.dhash(FLAT) == 0
    assert len(R.hash_vector(NOISE)) == 192


def test_blur():
    assert R.laplacian_variance(FLAT) == pytest.approx(0)
    assert R.laplacian_variance(NOISE) > P.BLUR_LIMIT > R.laplacian_variance(K.gaussian(NOISE, 5))
    one = np.zeros((9, 9))
    one[4, 4] = 1
    assert R.laplacian_variance(one) == pytest.approx((16 + 4) / 81)
    assert K.enhanced(FLAT).shape == FLAT.shape and K.enhanced(FLAT).dtype == np.uint8


def test_ssim():
    assert K.ssim(NOISE, NOISE) == pytest.approx(1)
    other = RNG.integers(0, 256, NOISE.shape, dtype=np.uint8)
    assert 0 <= K.ssim(NOISE, other) < 0.9
    a, b = np.full((20, 20), 50.0), np.full((20, 20), 100.0)
    c1 = (0.01 * 255) ** 2
    assert K.ssim(a, b, None) == pytest.approx((2 * 5000 + c1) / (2500 + 10000 + c1))


def test_resize():
    assert K.resize(FLAT, 10, 7).shape == (10, 7, 3) and np.allclose(K.resize(FLAT, 10, 7), 90)
    assert K.resize(np.array([[0.0, 2], [4, 6]]), 1, 1)[0, 0] == pytest.approx(3)
    assert R.capped(NOISE, 100, 50).shape[:2] == (50, 50) and R.capped(NOISE, 10**6, 5) is NOISE
    assert R.fitted(FLAT, 32, 100).shape[:2] == (32, 24)


def test_histogram():
    h = R.histogram(FLAT, hsv=False)
    assert h[2 * 73] == pytest.approx(1) and np.linalg.norm(R.histogram(NOISE)) == pytest.approx(1)
    red = np.zeros((1, 1, 3), np.uint8)
    red[0, 0, 2] = 255
    assert R.to_hsv(red).tolist() == [[[0, 255, 255]]]


def test_crop_and_variations():
    smooth = K.gaussian(RNG.integers(0, 256, (120, 120)), 3)
    assert K.is_cropped(smooth, smooth[20:80, 30:90]) and not K.is_cropped(smooth, RNG.random((60, 60)) * 255)
    v = R.variations(NOISE, NOISE)
    assert v == {"size_diff": False, "crop_detected": False, "brightness_diff": 0.0, "compression_diff": False, "format_diff": False}


def test_motion():
    field = K.gaussian(RNG.integers(0, 256, (64, 64)), 2)
    assert K.motion(field, field) == 0
    assert K.motion(field[:48, :48], np.roll(field, 3, axis=1)[:48, :48]) == pytest.approx(3, abs=1)
    assert R.heat_map(FLAT, FLAT).shape == FLAT.shape and (R.blend(FLAT, FLAT, 0.3) == 90).all()


def test_vectors():
    assert np.linalg.norm(R.thumbnail_embedding(NOISE)) == pytest.approx(1, abs=1e-5)
    assert R.keypoint_vector(NOISE).shape == (128,) and not R.keypoint_vector(FLAT).any()


def test_column_functions_equal_numpy(spark):
    """Hashes, sharpness, bins, thumbnails and sizes of odd pictures, against the numpy versions."""
    shapes = [(40, 37, 3), (8, 8, 1), (5, 70, 3), (100, 64, 1), (33, 33, 4), (1, 9, 1)]
    rows = [(i, (*shape, RNG.integers(0, 256, shape, dtype=np.uint8).tobytes())) for i, shape in enumerate(shapes)] + [(97, None), (98, (0, 4, 1, b"")), (99, (2, 2, 1, b"abc"))]
    df = spark.createDataFrame(rows, "id long, image struct<height:int,width:int,nChannels:int,data:binary>")
    image = F.col("image")
    hashed = {m: {r["id"]: (r["phash"], r["dhash"], r["whash"]) for r in I.hashes(df, max_pixels=600, longest=20, method=m).collect()} for m in ("area", "nearest")}
    vectors = {r["id"]: r["v"] for r in I.hashes(df).select("id", P.hash_vector(F.struct("phash", "dhash", "whash")).alias("v")).collect()}
    small = df.select("id", P.sharpness(image).alias("s")).collect()
    other = {r["id"]: r for r in df.select("id", P.thumbnail(image).alias("t"), P.color_bins(image).alias("b"), P.fitted(image, 20, 30).alias("f"), P.within(image, 30).alias("w")).collect()}
    for r in small:
        x = K.decode(dict(zip(("height", "width", "nChannels", "data"), dict(rows)[r["id"]], strict=True))) if dict(rows)[r["id"]] else None
        o = other[r["id"]]
        if x is None:
            assert hashed["area"][r["id"]] == hashed["nearest"][r["id"]] == (None, None, None)
            assert all(v is None for v in (r["s"], o["t"], o["b"], o["f"], o["w"]))
            continue
        for method, found in hashed.items():
            y = R.capped(x, 600, 20, method)
            assert found[r["id"]] == (R.phash(y), R.dhash(y), R.whash(y))
        assert r["s"]["blur_score"] == pytest.approx(R.laplacian_variance(x)) and r["s"]["contrast"] == pytest.approx(K.gray(x).std())
        assert np.allclose(o["t"], R.thumbnail_embedding(x), atol=1e-5) and list(vectors[r["id"]]) == R.hash_vector(x).tolist()
        assert (o["f"]["height"], o["f"]["width"]) == R.fitted(x, 20, 30).shape[:2] and max(o["w"]["height"], o["w"]["width"]) <= 30
        assert np.abs(np.frombuffer(o["f"]["data"], np.uint8) - R.fitted(x, 20, 30).reshape(-1)).max() <= 0.5 + 1e-6
        if x.shape[2] >= 3:
            counts = np.bincount(o["b"], minlength=512)
            assert np.allclose(counts / np.linalg.norm(counts), R.histogram(x))


def test_pictures_side_by_side(spark):
    rows = [([0.0, 128.0, 255.0], [0.0, 0.0, 0.0], [[1.0, 2.0], [3.0, 6.0]], [])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, d array<array<double>>, e array<array<double>>")
    got = df.select(P.blend(F.col("a"), F.col("b"), 0.5).alias("m"), P.heat(F.col("a"), F.col("b")).alias("h"), P.pooled(F.col("d"), 2).alias("p"), P.pooled(F.col("e"), 2).alias("z")).first()
    want = R.heat_map(np.array([[0, 128, 255]]), np.zeros((1, 3))).reshape(-1)
    assert got["m"] == [0, 64, 127.5] and np.abs(np.array(got["h"]) - want).max() < 1
    assert got["p"] == [2, 4, 1, 2] and got["z"] == [0] * 4
