"""Scalar column functions: vector measures, hashes, sizes, names and dates.  All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats: image extensions that scans accept, and the bonus of formats when a best copy is chosen.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp")
LOSSLESS_BONUS, JPEG_BONUS = ("png", "tiff", "bmp"), ("jpg", "jpeg")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def total(v: Column) -> Column:
    """Sum of an array of doubles, from the left."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2_similarity(squared: Column) -> Column:
    """1 / (1 + d) of the squared distance d, as flat L2 indexes report it."""
    return 1 / (1 + squared)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; null where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def median_bits(v: Column | str) -> Column:
    """One character for each element: 1 where it exceeds the median of all.  (An element exceeds the median if it
    exceeds the mean of the middle two; the sort is done once, outside of the lambda, by binding it in an array.)"""
    s = F.array_sort(doubles(v))
    n = F.size(_col(v))
    bound = F.transform(F.array(s), lambda o: (F.element_at(o, F.greatest(F.lit(1), F.floor((n + 1) / 2).cast("int"))) + F.element_at(o, F.least(n, F.floor(n / 2).cast("int") + 1))) / 2)
    bits = F.transform(bound, lambda mid: F.array_join(F.transform(doubles(v), lambda x: F.when(x > mid, F.lit("1")).otherwise(F.lit("0"))), ""))
    return F.when(n > 0, F.element_at(bits, 1))


def bits_to_long(bits: Column | str) -> Column:
    """A string of up to 64 binary digits as a signed 64-bit number."""
    return F.aggregate(F.split(_col(bits), ""), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 1).bitwiseOR(F.when(c == "1", F.lit(1)).otherwise(F.lit(0)).cast("long")))


def histogram_correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r of two histograms; null where one is constant."""
    n = F.size(_col(a)).cast("double")
    sa, sb = total(doubles(a)), total(doubles(b))
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    varies = (va > dot(a, a) * 1e-12) & (vb > dot(b, b) * 1e-12)
    return F.when(varies, (dot(a, b) - sa * sb / n) / F.sqrt(va * vb))


def histogram_chi_square(a: Column | str, b: Column | str) -> Column:
    """Sum of (a - b)^2 / a over bins where a is not 0."""
    return total(F.zip_with(doubles(a), doubles(b), lambda p, q: F.when(p != 0, (p - q) * (p - q) / p).otherwise(F.lit(0.0))))


def histogram_intersection(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda p, q: F.least(p, q)))


def mean_abs_difference(a: Column | str, b: Column | str) -> Column:
    return F.when(F.size(_col(a)) > 0, total(F.zip_with(doubles(a), doubles(b), lambda p, q: F.abs(p - q))) / F.size(_col(a)))


def quantize(v: Column | str, low: Column, high: Column, bits: int = 8) -> Column:
    """Codes 0 to 2**bits - 1 between the collection's minimum and maximum; 0 if both are equal."""
    top = float((1 << bits) - 1)
    return F.transform(doubles(v), lambda x: F.when(high > low, F.round((x - low) / (high - low) * top)).otherwise(F.lit(0.0)).cast("int"))


def kb_bucket(size: Column | str) -> Column:
    """Size in bytes, rounded down to whole KiB."""
    return F.floor(_col(size) / 1024).cast("long") * 1024


def human_size(size: Column | str) -> Column:
    """Size with two decimals in B, KB ... PB; ties go to the even digit."""
    size, out = _col(size).cast("double"), None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB", "PB")))):
        text = F.format_string(f"%.2f {unit}", F.bround(size / float(1024**k), 2))
        out = text if out is None else F.when(size < float(1024 ** (k + 1)), text).otherwise(out)
    return out


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many decimals, by the product as floating point has it: 100 * 0.0045 is 0.44999999999999996, ten times that
    is 4.5, so it becomes 0.5.  (round() goes by the decimal digits of x and gives 0.4.)"""
    return F.round(_col(x) * float(10**digits)) / float(10**digits)


def percent(share: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.bround(_col(share) * 100, digits))


def sanitize_filename(name: Column | str) -> Column:
    """Slashes to underscores, only word characters, spaces, dots and dashes; over 255 characters the first 250 and
    the extension."""
    flat = F.regexp_replace(F.regexp_replace(_col(name), r"[/\\]", "_"), r"(?U)[^\w\s.-]", "")
    ext = F.regexp_extract(flat, r"(\.[^.]*)$", 1)
    return F.when(F.length(flat) > 255, F.concat(F.substring(flat, 1, 250), ext)).otherwise(flat)


def ellipsis(name: Column | str, limit: int = 20) -> Column:
    name = _col(name)
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit - 3), F.lit("..."))).otherwise(name)


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-case extension without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def is_image_path(path: Column | str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def mime_type(content: Column | str) -> Column:
    """image/... by the first bytes of a file; null for anything else."""
    head = F.hex(F.substring(_col(content), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), F.lit("image/jpeg")).when(head.startswith("89504E470D0A1A0A"), F.lit("image/png")).when(head.startswith("474946"), F.lit("image/gif"))
        .when(head.startswith("424D"), F.lit("image/bmp")).when(head.startswith("49492A00") | head.startswith("4D4D002A"), F.lit("image/tiff"))
        .when(head.startswith("52494646") & head.endswith("57454250"), F.lit("image/webp"))
    )


def is_valid_image(path: Column | str, size: Column | str, content: Column | str | None = None, max_bytes: int = 50 << 20) -> Column:
    """Allowed extension, at most max_bytes, and - where content is given - image bytes."""
    good = is_image_path(path) & (_col(size) <= max_bytes)
    return good if content is None else good & mime_type(content).isNotNull()


def age_days(then: Column | str, as_of: str) -> Column:
    """Whole days from `then` to as_of, rounded down."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(_col(then).cast("timestamp"))
    return F.floor(seconds / 86400).cast("long")


def older_than(then: Column | str, as_of: str, days: int) -> Column:
    return _col(then).cast("timestamp") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def stamp(then: Column | str) -> Column:
    return F.date_format(_col(then), "yyyyMMdd_HHmmss")


def seek_frame(seconds: Column | str | None, fps: Column | str, n_frames: Column | str) -> Column:
    """Frame at a time; the middle one where no time is given."""
    middle = F.floor(_col(n_frames) / 2).cast("long")
    return middle if seconds is None else F.coalesce(F.floor(_col(seconds) * _col(fps)).cast("long"), middle)


def representative_score(size: Column | str, width: Column | str, height: Column | str, path: Column | str, modified: Column | str, as_of: str) -> Column:
    """MB + megapixels + format bonus (10 lossless, 5 JPEG) + age in years: the largest is the copy to keep."""
    ext = extension(path)
    bonus = F.when(ext.isin(*LOSSLESS_BONUS), 10.0).when(ext.isin(*JPEG_BONUS), 5.0).otherwise(0.0)
    return _col(size) / 1048576.0 + _col(width).cast("double") * _col(height) / 1e6 + bonus + age_days(modified, as_of) / 365.0


def quality_score(sharpness: Column | str, width: Column | str, height: Column | str, contrast: Column | str) -> Column:
    """0.5 * Laplacian variance + 0.3 * megapixels + 0.2 * standard deviation of the gray values."""
    return 0.5 * _col(sharpness) + 0.3 * (_col(width).cast("double") * _col(height) / 1e6) + 0.2 * _col(contrast)


def similarity_label(score: Column | str) -> Column:
    return F.when(_col(score) > 0.95, "Very similar").when(_col(score) > 0.8, "Similar").otherwise("Different")
