"""Column functions over images: sharpness, color bins, resizing and thumbnails, as built-in expressions.

They cost an interpreted step a pixel, so they are for small pictures; of pictures of any size, images.looked() makes the
sums, counts and small pictures that measures() and unit() start from.

An image is a struct (height, width, nChannels, data) of bytes by row, pixel and channel (blue, green, red).  Gray pictures
are arrays of numbers by row.  What a lambda reads more than once is bound by let(), so that it is computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.scalars import total

#: Below this variance of the Laplacian an image is blurred; the weights of blue, green and red.
BLUR_LIMIT, LUMA = 100.0, (0.114, 0.587, 0.299)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_to(n: Column | int) -> Column:
    """0, 1 ... n - 1; nothing for 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def whole(image: Column) -> Column:
    """Whether the bytes fill the picture; null and empty images don't."""
    return (image["height"] >= 1) & (image["width"] >= 1) & (F.octet_length(image["data"]) == image["height"] * image["width"] * image["nChannels"])


def levels(image: Column) -> Column:
    """All bytes as numbers."""
    return F.transform(F.split(F.decode(image["data"], "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("double"))


def to_bytes(numbers: Column) -> Column:
    """Numbers, rounded and clipped to 0 to 255, as bytes."""
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.round(x).cast("int")))), 2, "0")
    return F.unhex(F.array_join(F.transform(numbers, byte), ""))


def channel(image: Column, of: Column, c: int) -> Column:
    """One channel's numbers; images of fewer channels have their first one in all places."""
    n = image["nChannels"]
    return F.transform(count_to(image["height"] * image["width"]), lambda i: F.get(of, i * n + F.when(n > c, F.lit(c)).otherwise(F.lit(0))))


def gray(image: Column) -> Column:
    """Luma; the first channel of images with fewer than three."""
    n = image["nChannels"]

    def mixed(of: Column) -> Column:
        luma = lambda i: sum((F.get(of, i * n + k) * w for k, w in enumerate(LUMA)), F.lit(0.0))
        return F.when(n == 1, of).otherwise(F.transform(count_to(image["height"] * image["width"]), lambda i: F.when(n < 3, F.get(of, i * n)).otherwise(luma(i))))

    return F.when(whole(image), let(levels(image), mixed))


def _cells(size: Column, to: Column) -> Column:
    """How `to` numbers come from an axis of `size`: each is inv * (the sum from first to last, less wf times the first
    and wl times the last).  That is the mean of what a cell covers when shrinking, linear interpolation when growing."""
    def one(k: Column) -> Column:
        low, high = k * size / to, (k + 1) * size / to
        place = F.greatest(F.lit(0.0), F.least((k + 0.5) * size / to - 0.5, size - 1.0))
        shrinks = to <= size
        first = F.when(shrinks, F.floor(low)).otherwise(F.floor(place)).cast("int")
        last = F.when(shrinks, F.least(size, F.ceil(high).cast("int")) - 1).otherwise(F.least(F.floor(place).cast("int") + 1, size - 1))

        def weighed(ends: Column) -> Column:
            first, last = ends["first"], ends["last"]
            wf = F.when(shrinks, low - first).when(last > first, place - first).otherwise(0.0)
            wl = F.when(shrinks, last + 1 - high).when(last > first, 1 - (place - first)).otherwise(0.0)
            return F.struct(first.alias("first"), last.alias("last"), wf.alias("wf"), wl.alias("wl"), F.when(shrinks, 1 / (high - low)).otherwise(1.0).alias("inv"))

        return let(F.struct(first.alias("first"), last.alias("last")), weighed)

    return F.transform(count_to(to), one)


def resized(picture: Column, height: Column, width: Column, rows: Column | int, cols: Column | int, method: str = "area") -> Column:
    """The picture - a bound variable, as it is read for each number - with other sides, as an array of rows; method
    nearest picks pixels instead."""
    rows, cols = (F.lit(x) if isinstance(x, int) else x for x in (rows, cols))
    if method == "nearest":
        pick = lambda k, size, to: F.least(F.floor((k + 0.5) * size / to), size - 1).cast("int")
        return F.transform(count_to(rows), lambda r: F.transform(count_to(cols), lambda c: F.get(picture, pick(r, height, rows) * width + pick(c, width, cols))))

    def across(cells: Column) -> Column:
        number = lambda line, p: (total(F.slice(line, p["first"] + 1, p["last"] - p["first"] + 1)) - F.get(line, p["first"]) * p["wf"] - F.get(line, p["last"]) * p["wl"]) * p["inv"]
        row = lambda line: F.when(width == cols, line).otherwise(F.transform(cells, lambda p: number(line, p)))
        return F.transform(count_to(height), lambda y: let(F.slice(picture, y * width + 1, width), row))

    def down(lines: Column) -> Column:
        plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        less = lambda a, b, w: F.when(w == 0, a).otherwise(F.zip_with(a, b, lambda x, y: x - y * w))

        def row(p: Column) -> Column:
            added = F.aggregate(F.slice(lines, p["first"] + 2, p["last"] - p["first"]), F.get(lines, p["first"]), plus)
            return F.transform(less(less(added, F.get(lines, p["first"]), p["wf"]), F.get(lines, p["last"]), p["wl"]), lambda x: x * p["inv"])

        return F.when(height == rows, lines).otherwise(F.transform(_cells(height, rows), row))

    return let(let(_cells(width, cols), across), down)


def hash_vector(h: Column) -> Column:
    """The bits of (phash, dhash, whash) as 192 numbers."""
    bits = lambda c: F.transform(F.sequence(F.lit(63), F.lit(0)), lambda k: F.call_function("shiftrightunsigned", c, k).bitwiseAND(F.lit(1)).cast("float"))
    return let(h, lambda of: F.concat(bits(of["phash"]), bits(of["dhash"]), bits(of["whash"])))


def variance(numbers: Column) -> Column:
    return let(numbers, lambda v: let(total(v) / F.size(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))) / F.size(v)))


def sharpness(image: Column) -> Column:
    """(blur_score, brightness, contrast): variance of the 4-neighbour Laplacian with mirrored borders, mean and
    deviation of the gray picture."""
    h, w = image["height"], image["width"]

    def laplacian(g: Column) -> Column:
        def mirrored(i: Column, n: Column) -> Column:
            back = F.when(F.least(h, w) > 1, F.lit(1)).otherwise(F.lit(0))
            return F.when(i < 0, back).when(i >= n, n - 1 - back).otherwise(i)

        def one(i: Column) -> Column:
            y, x = F.floor(i / w).cast("int"), i % w
            around = [(mirrored(y + dy, h), mirrored(x + dx, w)) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
            return sum((F.get(g, (b * w + a).cast("int")) for b, a in around), F.lit(0.0)) - 4 * F.get(g, i)

        return F.transform(count_to(h * w), one)

    measures = lambda g: F.struct(variance(laplacian(g)).alias("blur_score"), (total(g) / F.size(g)).alias("brightness"), F.sqrt(variance(g)).alias("contrast"))
    return F.when(whole(image), let(gray(image), measures))


def measures(sums: Column) -> Column:
    """(blur_score, brightness, contrast) from the sums of kernels.tone()."""
    spread = lambda s, q: F.greatest(F.lit(0.0), (sums[q] - sums[s] * sums[s] / sums["n"]) / sums["n"])
    return F.when(sums["n"] > 0, F.struct(spread("bent", "bent2").alias("blur_score"), (sums["base"] + sums["shifted"] / sums["n"]).alias("brightness"), F.sqrt(spread("shifted", "shifted2")).alias("contrast")))


def unit(v: Column) -> Column:
    """Numbers, centred and of length 1."""
    centred = let(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda c: let(F.greatest(F.lit(1e-12), F.sqrt(total(F.transform(c, lambda x: x * x)))), lambda n: F.transform(c, lambda x: (x / n).cast("float"))))


def color_bins(image: Column, *, hsv: bool = True) -> Column:
    """For each pixel its number among 8 x 8 x 8 bins of hue (0 to 179), saturation and value, or of the channels."""
    n = image["nChannels"]

    def bins(of: Column) -> Column:
        def one(i: Column) -> Column:
            b, g, r = (F.get(of, i * n + F.when(n > c, F.lit(c)).otherwise(F.lit(0))) for c in range(3))
            if not hsv:
                return sum((F.floor(x / 32).cast("int") * m for x, m in ((b, 64), (g, 8), (r, 1))), F.lit(0))
            v = F.greatest(b, g, r)
            span = v - F.least(b, g, r)
            hue = F.when(span == 0, 0.0).when(v == r, (g - b) / span * 30).when(v == g, 60 + (b - r) / span * 30).otherwise(120 + (r - g) / span * 30)
            saturation = F.when(v > 0, span * 255 / v).otherwise(0.0)
            return (F.floor(F.pmod(hue, F.lit(180.0)) / 32) * 64 + F.floor(saturation / 32) * 8 + F.floor(v / 32)).cast("int")

        return F.transform(count_to(image["height"] * image["width"]), one)

    return F.when(whole(image), let(levels(image), bins))


def thumbnail(image: Column, side: int = 8) -> Column:
    """A stand-in for a neural embedding: the small color image, centred and of length 1."""
    h, w = image["height"], image["width"]

    def joined(of: Column) -> Column:
        small = F.array(*[let(channel(image, of, c), lambda one: F.flatten(resized(one, h, w, side, side))) for c in range(3)])
        return let(small, lambda s: F.flatten(F.transform(count_to(side * side), lambda i: F.array(*[F.get(F.get(s, F.lit(c)), i) for c in range(3)]))))

    return F.when(whole(image), let(let(levels(image), joined), unit))


def resized_image(image: Column, rows: Column, cols: Column) -> Column:
    """The image with other sides."""
    h, w, n = image["height"], image["width"], image["nChannels"]

    def data(of: Column) -> Column:
        one = lambda c: let(F.transform(count_to(h * w), lambda i: F.get(of, i * n + c)), lambda own: F.flatten(resized(own, h, w, rows, cols)))
        return let(F.transform(count_to(n), one), lambda s: to_bytes(F.flatten(F.transform(count_to(rows * cols), lambda i: F.transform(s, lambda of_one: F.get(of_one, i))))))

    return F.when(whole(image), F.struct(rows.cast("int").alias("height"), cols.cast("int").alias("width"), n.alias("nChannels"), let(levels(image), data).alias("data")))


def within(image: Column, longest: int) -> Column:
    """The image with its longer side at most `longest`."""
    h, w = image["height"], image["width"]
    side = lambda x: F.greatest(F.lit(1), F.floor(x * longest / F.greatest(h, w)).cast("int"))
    shape = ("height", "width", "nChannels", "data")
    return F.when(F.greatest(h, w) > longest, resized_image(image, side(h), side(w))).when(whole(image), F.struct(*[image[f].alias(f) for f in shape]))


def fitted(image: Column, rows: int, cols: int) -> Column:
    """The image at the largest size inside rows x cols with its aspect; may grow."""
    scale = F.least(F.lit(float(cols)) / image["width"], F.lit(float(rows)) / image["height"])
    side = lambda x: F.greatest(F.lit(1), F.floor(x * scale).cast("int"))
    return resized_image(image, side(image["height"]), side(image["width"]))


def brightness(image: Column) -> Column:
    """Mean of all bytes."""
    return F.when(whole(image), let(levels(image), lambda v: total(v) / F.size(v)))


def blend(first: Column, second: Column, share: float) -> Column:
    """Numbers of two pictures of one size, mixed."""
    return F.zip_with(first, second, lambda a, b: share * a + (1 - share) * b)


def heat(first: Column, second: Column) -> Column:
    """Absolute differences of two gray pictures of one size in false colors, blue for none to red for most."""
    band = lambda x, c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * x - c))) * 255
    return F.flatten(F.transform(F.zip_with(first, second, lambda a, b: F.abs(a - b) / 255), lambda x: F.array(*[band(x, c) for c in (1, 2, 3)])))


def pooled(descriptors: Column, size: int) -> Column:
    """Means and deviations of an array of descriptors; zeros where there is none."""
    def moments(of: Column) -> Column:
        means = F.transform(count_to(size), lambda k: total(F.transform(of, lambda d: F.get(d, k))) / F.size(of))
        spread = lambda m: F.transform(count_to(size), lambda k: F.sqrt(total(F.transform(of, lambda d: F.pow(F.get(d, k) - F.get(m, k), F.lit(2)))) / F.size(of)))
        return let(means, lambda m: F.concat(m, spread(m)))

    none = F.array_repeat(F.lit(0.0), 2 * size)
    return F.transform(F.when(F.size(descriptors) > 0, let(descriptors, moments)).otherwise(none), lambda x: x.cast("float"))
