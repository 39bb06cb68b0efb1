"""Numpy versions of the column functions over images: what these are held against."""

import numpy as np

from lumenfold.functions.kernels import corner_descriptors, gray, is_cropped, resize


def capped(image: np.ndarray, max_pixels: int, longest: int, method: str = "area") -> np.ndarray:
    """The image as it is up to max_pixels, else with its longer side at `longest`."""
    h, w = image.shape[:2]
    if h * w <= max_pixels:
        return image
    scale = longest / max(h, w)
    return resize(image, max(1, int(h * scale)), max(1, int(w * scale)), method)


def fitted(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The largest size inside height x width with the same aspect; may grow."""
    scale = min(width / image.shape[1], height / image.shape[0])
    return resize(image, max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale)))


def pack_bits(bits: np.ndarray) -> int:
    """64 booleans, first one highest, as a signed number."""
    return int(np.packbits(bits.reshape(-1)).view(">i8")[0])


def phash(image: np.ndarray) -> int:
    """Sign of the 8x8 lowest cosine coefficients of the 32x32 image against their median."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    low = basis @ resize(gray(image), 32, 32) @ basis.T
    low = np.round(low, 6)
    return pack_bits(low > np.median(low))


def dhash(image: np.ndarray) -> int:
    """Whether each pixel of the 8x9 image is darker than its right neighbour."""
    small = np.round(resize(gray(image), 8, 9), 6)
    return pack_bits(small[:, 1:] > small[:, :-1])


def whash(image: np.ndarray) -> int:
    """Block means - the lowest Haar band - at 8x8 against their median."""
    low = np.round(resize(gray(image), 8, 8), 6)
    return pack_bits(low > np.median(low))


def hash_vector(image: np.ndarray) -> np.ndarray:
    """The three hashes' bits as 192 numbers."""
    value = np.array([phash(image), dhash(image), whash(image)], dtype=">i8")
    return np.unpackbits(value.view(np.uint8)).astype(np.float32)


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, borders mirrored: low for blurred images."""
    g = np.pad(gray(image), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0 to 179, saturation and value 0 to 255."""
    b, g, r = (image[:, :, k].astype(np.float64) for k in range(3))
    v = np.maximum(np.maximum(r, g), b)
    span = v - np.minimum(np.minimum(r, g), b)
    safe = np.where(span > 0, span, 1)
    hue = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.stack([np.where(span > 0, hue % 180, 0), np.where(v > 0, span * 255 / np.where(v > 0, v, 1), 0), v], axis=2)


def histogram(image: np.ndarray, hsv: bool = True) -> np.ndarray:
    """8x8x8 color histogram, of length 1."""
    pixels = to_hsv(image) if hsv else image[:, :, :3]
    at = np.clip(pixels // 32, 0, 7).astype(int).reshape(-1, 3)
    h = np.bincount(at @ np.array([64, 8, 1]), minlength=512).astype(np.float64)
    return h / max(1e-300, np.linalg.norm(h))


def variations(first: np.ndarray, second: np.ndarray) -> dict:
    """How two copies differ; compression and format are not looked at."""
    differ = first.shape[:2] != second.shape[:2]
    return {"size_diff": differ, "crop_detected": differ and is_cropped(first, second), "brightness_diff": float(abs(first.astype(float).mean() - second.astype(float).mean())), "compression_diff": False, "format_diff": False}


def heat_map(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Absolute difference in false colours, blue for none to red for most."""
    x = np.abs(gray(first) - gray(second)) / 255
    band = lambda c: np.clip(1.5 - np.abs(4 * x - c), 0, 1) * 255
    return np.stack([band(1), band(2), band(3)], axis=2).astype(np.uint8)


def blend(first: np.ndarray, second: np.ndarray, share: float) -> np.ndarray:
    return np.clip(share * first.astype(float) + (1 - share) * second.astype(float), 0, 255).astype(np.uint8)


def thumbnail_embedding(image: np.ndarray, side: int = 8) -> np.ndarray:
    """A stand-in for a neural embedding: the small image, centred and of length 1."""
    colour = image if image.ndim == 3 and image.shape[2] >= 3 else np.repeat(gray(image)[:, :, None], 3, axis=2)
    v = resize(colour[:, :, :3], side, side).reshape(-1)
    v = v - v.mean()
    return (v / max(1e-12, np.linalg.norm(v))).astype(np.float32)


def keypoint_vector(image: np.ndarray) -> np.ndarray:
    """Mean and deviation of the corner descriptors, 128 numbers; zeros where there is no corner."""
    d = corner_descriptors(image)
    return np.concatenate((d.mean(axis=0), d.std(axis=0))).astype(np.float32) if len(d) else np.zeros(128, np.float32)
