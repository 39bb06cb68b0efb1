"""Image files: scans, metadata, decoding, and columns from pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lumenfold.functions import kernels as K
from lumenfold.functions import pixels as P
from lumenfold.functions import scalars as S

#: Presets of the entry points: which extensions are scanned.
PRESETS = {"all": S.IMAGE_EXTENSIONS, "duplicates": ("jpg", "jpeg", "png", "bmp", "gif"), "viewer": ("jpg", "jpeg", "png", "bmp", "gif", "tiff")}
MAX_PIXELS = 500_000_000


def canonical(path: Column | str) -> Column:
    """One spelling of local paths, which the file and image sources write differently."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan(spark: SparkSession, folder: str, *, recursive: bool = True, extensions: tuple[str, ...] = PRESETS["all"], with_content: bool = False) -> DataFrame:
    """(path, modified, size[, content]) of image files, by extension in any case.  An empty folder gives no rows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = rows.where(S.is_image_path("path", tuple(extensions)))
    out = rows.select(canonical("path").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), *(["content"] if with_content else []))
    return out


def load(spark: SparkSession, folder: str, *, recursive: bool = True, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """(path, image) of the files that can be decoded and are not larger than max_pixels."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.where(F.col("image.height").cast("long") * F.col("image.width") <= max_pixels).select(canonical("image.origin").alias("path"), "image")


def unreadable(scanned: DataFrame, images: DataFrame) -> DataFrame:
    """Scanned files that gave no image: the quarantine."""
    return scanned.join(images.select("path"), "path", "left_anti")


def metadata(scanned: DataFrame, images: DataFrame) -> DataFrame:
    """Catalog columns of readable files; pixels are not read for them."""
    size = images.select("path", F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))
    rows = scanned.join(size, "path")
    return rows.select(F.col("path").alias("file_path"), S.file_name("path").alias("file_name"), F.col("size").alias("file_size"), "width", "height", "channels", F.upper(S.extension("path")).alias("format"), F.col("modified").alias("modified_date"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, drawn out until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def spread(images: DataFrame, key: str) -> DataFrame:
    """images, dealt anew where a few large files would leave most cores idle: pixels cost far more than the shuffle."""
    cores = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(cores, key) if images.rdd.getNumPartitions() < cores else images


def pair_column(kernel: Callable[[np.ndarray, np.ndarray], object], returns: str):
    """A column function over two image structs."""

    @F.pandas_udf(returns)
    def column(first: pd.DataFrame, second: pd.DataFrame) -> pd.Series:
        pairs = [(K.decode(a), K.decode(b)) for a, b in zip(first.to_dict("records"), second.to_dict("records"), strict=True)]
        return pd.Series([None if a is None or b is None else kernel(a, b) for a, b in pairs], dtype=object)

    return column


def hashes(images: DataFrame, *, max_pixels: int = 2_000_000, longest: int = 1000, method: str = "area") -> DataFrame:
    """images plus phash, dhash and whash of the capped image; null where there is no image."""
    (name,) = fresh(images, "hashes")

    @F.pandas_udf("phash long, dhash long, whash long")
    def three(some: pd.DataFrame) -> pd.DataFrame:
        decoded = [K.decode(row) for row in some.to_dict("records")]
        found = [(None,) * 3 if x is None else K.hashes(x, max_pixels, longest, method) for x in decoded]
        return pd.DataFrame(found, columns=["phash", "dhash", "whash"], dtype=object).astype("Int64")

    return images.withColumn(name, three(F.col("image"))).select(*images.columns, f"{name}.*")


def looked(what: str, **how):
    """A column function over image structs that looks at each pixel once, strip by strip: "tone" (the sums that
    P.measures() needs), "colors" (those of 512 bins that have pixels, and their counts), "small" (side * side * 3 numbers), "mean" (of all bytes).  What
    follows are expressions over those few numbers.  Null where there is no picture."""
    kernels = {
        "tone": (K.tone, "n long, base double, shifted double, shifted2 double, bent double, bent2 double"),
        "colors": (lambda x: (at := np.flatnonzero(n := K.color_counts(x, how["hsv"])), n[at]), "bins array<long>, counts array<long>"),
        "small": (lambda x: K.shrunk(x, how["side"]).ravel(), "array<double>"),
        "mean": (lambda x: sum(int(x[a:b].sum()) for a, b in K.strips(x)) / x.size, "double"),
    }
    kernel, returns = kernels[what]
    names = [part.split()[0] for part in returns.split(", ")]

    @F.pandas_udf(returns)
    def struct(some: pd.DataFrame) -> pd.DataFrame:
        rows = [(None,) * len(names) if (x := K.decode(row)) is None else kernel(x) for row in some.to_dict("records")]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.astype({"n": "Int64", **dict.fromkeys(names[1:], "Float64")}) if what == "tone" else out

    @F.pandas_udf(returns if len(names) == 1 else "double")
    def plain(some: pd.DataFrame) -> pd.Series:
        return pd.Series([None if (x := K.decode(row)) is None else kernel(x) for row in some.to_dict("records")], dtype=object)

    return struct if len(names) > 1 else plain


def embedding(image: Column) -> Column:
    """The stand-in for a neural embedding: the 8 x 8 color picture, centred and of length 1."""
    small = looked("small", side=8)(image)
    return F.when(small.isNotNull(), P.let(small, P.unit))


def sharpness(images: DataFrame) -> DataFrame:
    """images plus blur_score (Laplacian variance), brightness and contrast of the gray image, and is_blurry."""
    (name,) = fresh(images, "measures")
    out = images.withColumn(name, looked("tone")(F.col("image"))).withColumn(name, P.measures(F.col(name))).select(*images.columns, f"{name}.*")
    return out.withColumn("is_blurry", F.col("blur_score") < P.BLUR_LIMIT)


def histograms(images: DataFrame, keys: list[str], *, hsv: bool = True, name: str = "vector") -> DataFrame:
    """(keys, vector): the 8 x 8 x 8 color histogram of each image, of length 1; images of a key are counted together."""
    (seen,) = fresh(images, "seen")  # of small pictures, a few bins of 512 leave Python
    found = images.select(*keys, looked("colors", hsv=hsv)(F.col("image")).alias(seen))
    at = found.select(*keys, F.explode(F.arrays_zip(f"{seen}.bins", f"{seen}.counts")).alias(seen)).select(*keys, F.col(f"{seen}.bins").cast("int").alias("bin"), F.col(f"{seen}.counts").alias("n"))
    counts = at.groupBy(*keys, "bin").agg(F.sum("n").cast("double").alias("n"))
    whole = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    dense = P.let(F.col("m"), lambda m: F.transform(P.count_to(512), lambda b: (F.coalesce(F.element_at(m, b), F.lit(0.0)) / F.col("norm")).cast("float")))
    return whole.select(*keys, dense.alias(name))


def sharpened(images: DataFrame) -> DataFrame:
    """images with blurred ones sharpened; the others don't go through Python's kernel."""
    (blurred,) = fresh(images, "blurred")

    @F.pandas_udf("height int, width int, nChannels int, data binary")
    def enhance(some: pd.DataFrame) -> pd.DataFrame:
        done = [None if (x := K.decode(row)) is None else K.enhanced(x) for row in some.to_dict("records")]
        return pd.DataFrame([(None,) * 4 if x is None else (*x.shape, x.tobytes()) for x in done], columns=["height", "width", "nChannels", "data"]).astype({c: "Int32" for c in ("height", "width", "nChannels")})

    shape = ("height", "width", "nChannels", "data")
    plain = F.struct(*[F.col(f"image.{c}").alias(c) for c in shape])
    rows = images.withColumn(blurred, P.measures(looked("tone")(F.col("image")))["blur_score"] < P.BLUR_LIMIT).withColumn("image", plain)
    done = enhance(F.when(F.col(blurred), F.col("image")))
    return rows.withColumn("image", F.when(F.col(blurred), done).otherwise(F.col("image"))).select(*images.columns)


#: Features by name that are column functions, `hash` of the hashes' columns; `histogram` is counted, and models of one's own come as `extractors`.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "embedding": embedding,
    "hash": lambda image: P.hash_vector(F.struct("phash", "dhash", "whash")),
    "keypoint": lambda image: P.pooled(_descriptors()(image), 64),
}


def _descriptors():
    @F.pandas_udf("array<array<double>>")
    def column(images: pd.DataFrame) -> pd.Series:
        decoded = [K.decode(row) for row in images.to_dict("records")]
        return pd.Series([None if x is None else K.corner_descriptors(x).tolist() for x in decoded], dtype=object)

    return column


@dataclass(frozen=True)
class BatchModel:
    """A model that is loaded once in a Python worker and sees `batch` pictures at a time: load() returns a function of an
    array (n, side, side, 3) of floats from 0 to 1 that returns n vectors."""

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    side: int = 224
    batch: int = 32


def predicted(images: DataFrame, model: BatchModel) -> DataFrame:
    """(path, vector) of a model.  Pictures are shrunk where they are decoded, so that what goes to the model has one
    size; what can't be decoded has no row."""
    side = model.side

    @F.pandas_udf("array<float>")
    def small(some: pd.DataFrame) -> pd.Series:
        decoded = [K.decode(row) for row in some.to_dict("records")]
        return pd.Series([None if x is None else K.small(x, side).ravel() for x in decoded], dtype=object)

    predict = predict_batch_udf(model.load, return_type=ArrayType(FloatType()), batch_size=model.batch, input_tensor_shapes=[[side, side, 3]])
    shrunk = images.select("path", small(F.col("image")).alias("small")).where("small is not null")
    return shrunk.select("path", predict("small").alias("vector"))


def extract_features(images: DataFrame, methods: tuple[str, ...] = ("embedding",), *, enhance: bool = True, extractors: dict | None = None) -> DataFrame:
    """(path, feature_type, vector): a row for each image and known method; unknown methods are skipped.
    Blurred images are sharpened before.  A model of one's own goes into `extractors`: a function of an image array, or
    a BatchModel."""
    own = extractors or {}
    rows = images.select("path", "image").where(P.whole(F.col("image")))
    rows = sharpened(rows) if enhance else rows
    built_in = [m for m in dict.fromkeys(methods) if m in FEATURES and m not in own]
    found = []
    if built_in:
        columns = [F.struct(F.lit(m).alias("feature_type"), F.col(f"f{k}").alias("vector")) for k, m in enumerate(built_in)]
        known = hashes(rows) if "hash" in built_in else rows
        vectors = known.select("path", *[FEATURES[m](F.col("image")).cast("array<float>").alias(f"f{k}") for k, m in enumerate(built_in)])
        found.append(vectors.select("path", F.explode(F.array(*columns)).alias("f")).select("path", "f.feature_type", "f.vector"))
    if "histogram" in methods and "histogram" not in own:
        found.append(histograms(rows, ["path"]).select("path", F.lit("histogram").alias("feature_type"), "vector"))
    for m in dict.fromkeys(methods):
        if m in own and isinstance(own[m], BatchModel):
            found.append(predicted(rows, own[m]).select("path", F.lit(m).alias("feature_type"), "vector"))
    chosen = [m for m in dict.fromkeys(methods) if m in own and not isinstance(own[m], BatchModel)]
    if chosen:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                decoded = [(path, K.decode(row)) for path, row in zip(pdf["path"], pdf["image"], strict=True)]
                yield pd.DataFrame([(path, m, np.asarray(own[m](x), dtype=np.float32)) for path, x in decoded for m in chosen], columns=["path", "feature_type", "vector"])

        found.append(rows.mapInPandas(run, "path string, feature_type string, vector array<float>"))
    if not found:
        return rows.sparkSession.createDataFrame([], "path string, feature_type string, vector array<float>")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def variations(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """pairs plus how the second image differs from the first.  Only images of different sizes are searched for a crop;
    compression and format are not looked at."""
    a, b = F.col(first), F.col(second)
    (differ, crop) = fresh(pairs, "differ", "crop")
    is_cropped = pair_column(K.is_cropped, "boolean")
    rows = pairs.withColumn(differ, (a["height"] != b["height"]) | (a["width"] != b["width"]))
    rows = rows.withColumn(crop, is_cropped(F.when(F.col(differ), a), F.when(F.col(differ), b)))
    mean = looked("mean")
    brightness = F.abs(mean(a) - mean(b))
    return rows.select(*pairs.columns, F.col(differ).alias("size_diff"), F.coalesce(F.col(crop), F.lit(False)).alias("crop_detected"), brightness.alias("brightness_diff"), F.lit(False).alias("compression_diff"), F.lit(False).alias("format_diff"))
