"""The few pixel kernels that built-in expressions can't express well: neighbourhoods of whole pictures.

Images are height x width x channels arrays (uint8, channels blue, green, red).  They run inside Arrow-batched
functions, which see each pixel of a hash once; sharpness, color bins and resizing are column functions, in pixels.py.
"""

from __future__ import annotations

import functools

import numpy as np

#: Fixed values of the measures: structural similarity, and what counts as cropped.
SSIM_WINDOW, SSIM_K1, SSIM_K2 = 7, 0.01, 0.03
CROP_MATCH = 0.85
#: The largest matrix of weights that is kept, in numbers.
KEPT = 1 << 13
#: The 8 lowest cosines over 32 places.
BASIS = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64)


def decode(row) -> np.ndarray | None:
    """An image struct (height, width, nChannels, data) as an array; None for what could not be read."""
    if row is None or not isinstance(row["data"], bytes | bytearray) or not row["height"] >= 1 or not row["width"] >= 1:  # also for NaN
        return None
    shape = (int(row["height"]), int(row["width"]), int(row["nChannels"]))
    data = np.frombuffer(row["data"], np.uint8)
    return data.reshape(shape) if data.size == shape[0] * shape[1] * shape[2] else None


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green, red; the first channel of anything else."""
    if image.ndim == 2:
        return image.astype(np.float64)
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.float64)
    return image[:, :, :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def _axis_weights(size: int, to: int) -> np.ndarray:
    """(to, size) matrix: averages of covered cells when shrinking, linear interpolation when growing.  Small ones are
    kept, as pictures often have the same sides."""
    return _kept_weights(size, to) if size * to <= KEPT else _new_weights(size, to)


def _new_weights(size: int, to: int) -> np.ndarray:
    if to <= size:
        edges, cells = np.arange(to + 1)[:, None] * size / to, np.arange(size)
        out = np.maximum(np.minimum(cells + 1, edges[1:]) - np.maximum(cells, edges[:-1]), 0)
    else:
        out = np.zeros((to, size))
        at = np.clip((np.arange(to) + 0.5) * size / to - 0.5, 0, size - 1)
        low = at.astype(int)
        high = np.minimum(low + 1, size - 1)
        out[np.arange(to), low] += 1 - (at - low)
        out[np.arange(to), high] += at - low
    out /= out.sum(axis=1, keepdims=True)
    out.flags.writeable = False
    return out


_kept_weights = functools.lru_cache(maxsize=512)(_new_weights)


def resize(image: np.ndarray, height: int, width: int, method: str = "area") -> np.ndarray:
    """The image at another size, as floats; method nearest picks pixels instead."""
    if method == "nearest":
        y = np.minimum((np.arange(height) + 0.5) * image.shape[0] / height, image.shape[0] - 1).astype(int)
        x = np.minimum((np.arange(width) + 0.5) * image.shape[1] / width, image.shape[1] - 1).astype(int)
        return image[y][:, x].astype(np.float64)
    rows, cols = _axis_weights(image.shape[0], height), _axis_weights(image.shape[1], width)
    if image.ndim == 2:
        return rows @ (image.astype(np.float64, copy=False) @ cols.T)
    return np.einsum("ij,j...->i...", rows, np.einsum("kl,il...->ik...", cols, image.astype(np.float64)))


def small(image: np.ndarray, side: int) -> np.ndarray:
    """side x side x 3 floats from 0 to 1; gray pictures have three equal channels."""
    colors = image[:, :, :3] if image.shape[2] >= 3 else np.repeat(image[:, :, :1], 3, axis=2)
    rows, cols = (_axis_weights(n, side).astype(np.float32) for n in colors.shape[:2])
    half = np.tensordot(rows, colors.astype(np.float32), axes=(1, 0))
    return np.tensordot(half, cols, axes=(1, 1)).transpose(0, 2, 1) / np.float32(255)


def strips(image: np.ndarray, pixels: int = 1 << 16):
    """(first row, last row) of parts of about so many pixels: what is computed in floats stays small."""
    step = max(1, pixels // max(1, image.shape[1]))
    for y in range(0, image.shape[0], step):
        yield y, min(image.shape[0], y + step)


def tone(image: np.ndarray) -> tuple[int, float, float, float, float, float]:
    """Pixels, the first gray value, and the sums of what gray values differ from it by and of the 4-neighbour Laplacian
    with mirrored borders, plain and squared."""
    h, w = image.shape[:2]
    back, base = (1 if min(h, w) > 1 else 0), float(gray(image[:1, :1])[0, 0])
    out = np.zeros(4)
    for a, b in strips(image):
        g = gray(image[a:b])
        up = np.vstack((gray(image[a - 1 : a] if a else image[back : back + 1]), g[:-1]))
        down = np.vstack((g[1:], gray(image[b : b + 1] if b < h else image[h - 1 - back : h - back])))
        left, right = np.hstack((g[:, back : back + 1], g[:, :-1])), np.hstack((g[:, 1:], g[:, w - 1 - back : w - back]))
        bent, shifted = up + down + left + right - 4 * g, g - base
        out += shifted.sum(), (shifted * shifted).sum(), bent.sum(), (bent * bent).sum()
    return h * w, base, *out.tolist()


def color_counts(image: np.ndarray, hsv: bool) -> np.ndarray:
    """Pixels in each of 8 x 8 x 8 bins of hue (0 to 179), saturation and value, or of the channels."""
    counts = np.zeros(512, np.int64)
    for a, b in strips(image):
        some = image[a:b]
        b_, g_, r_ = (some[:, :, c if some.shape[2] > c else 0] for c in range(3))
        if not hsv:
            at = (b_ >> 5).astype(np.int32) * 64 + (g_ >> 5) * 8 + (r_ >> 5)
        else:
            blue, green, red = (x.astype(np.float64) for x in (b_, g_, r_))
            v = np.maximum(np.maximum(blue, green), red)
            span = v - np.minimum(np.minimum(blue, green), red)
            part = np.where(span == 0, 1, span)
            hue = np.where(span == 0, 0.0, np.where(v == red, (green - blue) / part * 30, np.where(v == green, 60 + (blue - red) / part * 30, 120 + (red - green) / part * 30)))
            saturation = np.where(v > 0, span * 255 / np.where(v > 0, v, 1), 0)
            at = (np.floor((hue + 180) % 180 / 32) * 64 + np.floor(saturation / 32) * 8 + np.floor(v / 32)).astype(np.int32)
        counts += np.bincount(at.ravel(), minlength=512)
    return counts


def shrunk(image: np.ndarray, side: int) -> np.ndarray:
    """side x side x 3 numbers; pictures of fewer channels have their first one in all places."""
    rows, cols = _axis_weights(image.shape[0], side), _axis_weights(image.shape[1], side)
    half = [np.zeros((side, image.shape[1])) for _ in range(3)]
    for a, b in strips(image):
        for c in range(3):
            half[c] += rows[:, a:b] @ image[a:b, :, c if image.shape[2] > c else 0].astype(np.float64)
    return np.stack([x @ cols.T for x in half], axis=2)


def hashes(image: np.ndarray, max_pixels: int, longest: int, method: str = "area") -> tuple[int, int, int]:
    """Perceptual, difference and wavelet hash of the gray image, with its longer side at `longest` if it has more than
    max_pixels: signs of the 8 x 8 lowest cosine coefficients of the 32 x 32 image against their median; whether a pixel
    of the 8 x 9 image is darker than its right neighbour; block means - the lowest Haar band - against their median.
    Differences below 1e-6 are rounding."""
    picture = gray(image)
    h, w = picture.shape
    if h * w > max_pixels:
        picture = resize(picture, max(1, int(h * longest / max(h, w))), max(1, int(w * longest / max(h, w))), method)
    low, blocks, steps = BASIS @ resize(picture, 32, 32) @ BASIS.T, resize(picture, 8, 8), resize(picture, 8, 9)
    bits = (low > np.median(low) + 1e-6, steps[:, 1:] > steps[:, :-1] + 1e-6, blocks > np.median(blocks) + 1e-6)
    return tuple(int(np.packbits(b.reshape(-1)).view(">i8")[0]) for b in bits)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, int(3 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * out.ndim
        pad[axis] = (r, r)
        padded = np.pad(out, pad, mode="edge")
        out = sum(w[k] * np.take(padded, range(k, k + out.shape[axis]), axis=axis) for k in range(2 * r + 1))
    return out


def clipped_equalize(channel: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Contrast by tile: each tile's clipped cumulative histogram, blended linearly between tile centres."""
    h, w = channel.shape
    levels = np.clip(channel, 0, 255).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    for a in range(tiles):
        for b in range(tiles):
            own = levels[ys[a] : max(ys[a + 1], ys[a] + 1), xs[b] : max(xs[b + 1], xs[b] + 1)]
            counts = np.bincount(own.reshape(-1), minlength=256).astype(float)[:256]
            limit = max(1.0, clip * own.size / 256)
            extra = np.maximum(counts - limit, 0).sum()
            counts = np.minimum(counts, limit) + extra / 256
            maps[a, b] = np.cumsum(counts) * 255 / max(1.0, counts.sum())
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], levels]
    return (1 - wy) * ((1 - wx) * at(y0, x0) + wx * at(y0, x1)) + wy * ((1 - wx) * at(y1, x0) + wx * at(y1, x1))


def enhanced(image: np.ndarray) -> np.ndarray:
    """Unsharp mask, then contrast by tile on the lightness (here: luma)."""
    sharp = np.clip(1.5 * image - 0.5 * gaussian(image, 2.0), 0, 255)
    light = gray(sharp)
    gain = clipped_equalize(light) - light
    return np.clip(sharp + (gain[:, :, None] if image.ndim == 3 else gain), 0, 255).astype(np.uint8)


def _box_sums(x: np.ndarray, n: int) -> np.ndarray:
    h, w = x.shape[0] - n + 1, x.shape[1] - n + 1
    down = x[:h].copy()
    for k in range(1, n):
        down += x[k : k + h]
    out = down[:, :w].copy()
    for k in range(1, n):
        out += down[:, k : k + w]
    return out


def ssim(first: np.ndarray, second: np.ndarray, side: int | None = 512) -> float:
    """Mean structural similarity of the gray images, both resized to side x side, or to the smaller of both; 1 for equal
    images."""
    if first.shape == second.shape and np.array_equal(first, second):
        return 1.0
    a, b = gray(first), gray(second)
    h, w = (side, side) if side else (min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1]))
    a, b, n = resize(a, h, w), resize(b, h, w), min(SSIM_WINDOW, h, w)
    count, total, places = n * n, 0.0, (h - n + 1) * (w - n + 1)
    unbiased = count / max(1, count - 1)
    c1, c2 = (SSIM_K1 * 255) ** 2, (SSIM_K2 * 255) ** 2
    step = max(1, (1 << 13) // w)
    for y in range(0, h - n + 1, step):  # a few rows at a time stay in the processor's cache
        x, z = a[y : y + step + n - 1], b[y : y + step + n - 1]
        ma, mb = _box_sums(x, n) / count, _box_sums(z, n) / count
        va, vb = unbiased * (_box_sums(x * x, n) / count - ma * ma), unbiased * (_box_sums(z * z, n) / count - mb * mb)
        cov = unbiased * (_box_sums(x * z, n) / count - ma * mb)
        total += float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).sum())
    return total / places


def best_match(large: np.ndarray, small: np.ndarray) -> float:
    """Highest normalised correlation of `small` at any place in `large`."""
    t = small - small.mean()
    size = tuple(np.array(large.shape) + np.array(small.shape) - 1)
    product = np.fft.irfft2(np.fft.rfft2(large, size) * np.fft.rfft2(t[::-1, ::-1], size), size)
    product = product[small.shape[0] - 1 : large.shape[0], small.shape[1] - 1 : large.shape[1]]
    sums = lambda x: (lambda c: c[small.shape[0] :, small.shape[1] :] - c[: -small.shape[0], small.shape[1] :] - c[small.shape[0] :, : -small.shape[1]] + c[: -small.shape[0], : -small.shape[1]])(np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
    spread = sums(large * large) - sums(large) ** 2 / small.size
    down = np.sqrt(np.maximum(spread, 0) * (t * t).sum())
    return float(np.where(down > 1e-6, product / np.maximum(down, 1e-6), 0).max())


def is_cropped(first: np.ndarray, second: np.ndarray) -> bool:
    """Whether the smaller image, at half scale, is found in the larger one."""
    a, b = sorted((gray(first), gray(second)), key=lambda x: x.size)
    if a.shape[0] > b.shape[0] or a.shape[1] > b.shape[1]:
        return False
    half = lambda x: resize(x, max(1, x.shape[0] // 2), max(1, x.shape[1] // 2))
    return best_match(half(b), half(a)) > CROP_MATCH


def motion(before: np.ndarray, after: np.ndarray, block: int = 16, reach: int = 7) -> float:
    """Mean displacement of blocks between frames, by exhaustive matching: an approximation of dense optical flow."""
    a, b = gray(before), gray(after)
    h, w = min(a.shape[0], b.shape[0]) // block * block, min(a.shape[1], b.shape[1]) // block * block
    if not h or not w:
        return 0.0
    padded = np.pad(b[:h, :w], reach, mode="edge")
    steps = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)), key=lambda s: s[0] ** 2 + s[1] ** 2)
    cost = np.stack([np.abs(padded[reach + dy : reach + dy + h, reach + dx : reach + dx + w] - a[:h, :w]).reshape(h // block, block, w // block, block).sum(axis=(1, 3)) for dy, dx in steps])
    return float(np.hypot(*np.array(steps)[cost.argmin(axis=0)].transpose(2, 0, 1)).mean())


def corner_descriptors(image: np.ndarray, most: int = 500, patch: int = 8) -> np.ndarray:
    """Descriptors (n, 64) of the strongest corners: centred patches of length 1."""
    g = gray(image)
    if min(g.shape) <= 2 * patch:
        return np.zeros((0, patch * patch))
    gy, gx = np.gradient(gaussian(g, 1.0))
    xx, yy, xy = (gaussian(v, 1.5) for v in (gx * gx, gy * gy, gx * gy))
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = response[patch:-patch, patch:-patch]
    order = np.argsort(-inner, axis=None, kind="stable")[:most]
    order = order[inner.reshape(-1)[order] > 1e-6]
    y, x = np.unravel_index(order, inner.shape)
    half = patch // 2
    out = np.array([g[a + patch - half : a + patch + half, b + patch - half : b + patch + half].reshape(-1) for a, b in zip(y, x, strict=True)]).reshape(-1, patch * patch)
    out = out - out.mean(axis=1, keepdims=True)
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


