"""Queries over images that Spark derives from the driver's tables: a vector is a picture of eight columns, a text is a
picture of its bytes.  SQL gives the same numbers from the same pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import kernels as K
from lumenfold.functions import pixels as P
from lumenfold.functions import scalars as S
from lumenfold.operators import detect, frames, groups
from lumenfold.sources import images as I
from lumenfold.sources.config import DuplicateSettings

REGISTERED: dict[str, tuple] = {}
#: Leader clustering of the rows of `embeddings` (vec_id) with edges e (i, j), in id order: m has (leader, member).
LEADERS = """
n AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY v.vec_id) AS rn, coalesce(list(e.i) FILTER (e.i IS NOT NULL), []::BIGINT[]) AS nb
      FROM embeddings v LEFT JOIN e ON e.j = v.vec_id GROUP BY v.vec_id),
r(rn, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
      SELECT r.rn + 1, CASE WHEN list_has_any(r.leaders, n.nb) THEN r.leaders ELSE list_append(r.leaders, n.id) END FROM r JOIN n ON n.rn = r.rn + 1),
l AS (SELECT unnest(leaders) AS id FROM (SELECT leaders FROM r ORDER BY rn DESC LIMIT 1)),
m AS (SELECT min(e.i) AS leader, e.j AS member FROM e JOIN l ON l.id = e.i WHERE e.j NOT IN (SELECT id FROM l) GROUP BY e.j)
"""


def register(sql: str | None = None):
    def add(query):
        REGISTERED[query.__name__] = (query, sql)
        return query

    return add


def text_pictures(spark, sf_dir: str, width: int = 32) -> DataFrame:
    """(id, size, image): documents' bytes as gray pictures of `width` columns, the last row filled with zeros; null and
    empty texts have no picture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data, size = F.encode("text", "utf-8"), F.octet_length("text")
    rows = F.ceil(size / width).cast("int")
    image = F.struct(rows.alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), F.rpad(data, rows * width, F.lit(b"\0")).alias("data"))
    rows = docs.select(F.col("doc_id").alias("id"), size.cast("long").alias("size"), F.when(size > 0, image).alias("image"))
    return I.spread(rows, "id")


def vector_pictures(spark, sf_dir: str) -> DataFrame:
    """(id, label, image): vectors as gray pictures of eight columns, 128 for 0 and for what fills the last row."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = F.ceil(F.size("embedding") / 8).cast("int")
    full = F.concat(S.doubles("embedding"), F.array_repeat(F.lit(0.0), rows * 8 - F.size("embedding")))
    image = F.struct(rows.alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), P.to_bytes(F.transform(full, lambda x: x * 255 + 128)).alias("data"))
    return v.select(F.col("vec_id").alias("id"), "label", F.when(rows > 0, image).alias("image"))


#: Pixels of the texts' pictures (id, h, y, x, v), their cells at other heights and widths, and bits as a number.
_TEXT_PIXELS = """
t AS (SELECT doc_id AS id, hex(encode(text)) AS d, (strlen(text) + 31) // 32 AS h FROM documents WHERE strlen(text) > 0),
px AS (SELECT id, h, p // 32 AS y, p % 32 AS x, CASE WHEN 2 * p < length(d) THEN ('0x' || substr(d, 2 * p + 1, 2))::INT ELSE 0 END::DOUBLE AS v
       FROM (SELECT id, h, d, unnest(range(0, h * 32)) AS p FROM t)),
heights AS (SELECT DISTINCT h, unnest([8, 32]) AS n FROM t),
cells AS (SELECT h AS size, n, unnest(range(0, n)) AS k FROM heights UNION ALL SELECT 32, n, unnest(range(0, n)) FROM (VALUES (8), (9), (32)) s(n)),
spread AS (SELECT DISTINCT size, n, k, i, least(i + 1, (k + 1) * size / n) - greatest(i, k * size / n) AS wt FROM (SELECT size, n, k, unnest(range(floor(k * size / n)::BIGINT, least(size, ceil((k + 1) * size / n)::BIGINT))) AS i FROM cells WHERE n <= size)),
place AS (SELECT DISTINCT size, n, k, greatest(0.0, least((k + 0.5) * size / n - 0.5, size - 1.0))::DOUBLE AS spot FROM cells WHERE n > size),
both_w AS (SELECT size, n, k, i, wt / sum(wt) OVER (PARTITION BY size, n, k) AS wt FROM spread UNION ALL
           SELECT size, n, k, floor(spot)::BIGINT, 1 - (spot - floor(spot)) FROM place UNION ALL SELECT size, n, k, least(floor(spot)::BIGINT + 1, size - 1), spot - floor(spot) FROM place),
wide AS (SELECT id, h, y, n AS cols, k AS c, sum(v * wt) AS v FROM px JOIN both_w b ON b.size = 32 AND b.i = px.x GROUP BY ALL),
small AS (SELECT id, b.n AS rows, cols, b.k AS r, c, sum(v * wt) AS v FROM wide JOIN both_w b ON b.size = wide.h AND b.i = wide.y
          WHERE (b.n = 32 AND cols = 32) OR (b.n = 8 AND cols IN (8, 9)) GROUP BY ALL)
"""
_PACK = "sum(CASE WHEN {bit} THEN (1::HUGEINT << (63 - ({place}))::INT) ELSE 0 END)"
_SIGNED = "CASE WHEN {x} >= 9223372036854775808::HUGEINT THEN {x} - 18446744073709551616::HUGEINT ELSE {x} END::BIGINT"
_HASHES = (
    "WITH " + _TEXT_PIXELS + """,
basis AS (SELECT u, i, cos(pi() * (2 * i + 1) * u / 64) AS b FROM range(0, 8) a(u), range(0, 32) c(i)),
half AS (SELECT id, r, u AS v_at, sum(v * b) AS v FROM small JOIN basis ON i = c WHERE rows = 32 GROUP BY ALL),
low AS (SELECT id, u * 8 + v_at AS k, sum(v * b) AS v FROM half JOIN basis ON i = r GROUP BY ALL),
p AS (SELECT id, """ + _PACK.format(bit="v > m + 1e-6", place="k") + """ AS x FROM (SELECT *, median(v) OVER (PARTITION BY id) AS m FROM low) GROUP BY id),
w AS (SELECT id, """ + _PACK.format(bit="v > m + 1e-6", place="r * 8 + c") + """ AS x FROM (SELECT *, median(v) OVER (PARTITION BY id) AS m FROM small WHERE rows = 8 AND cols = 8) GROUP BY id),
d AS (SELECT a.id, """ + _PACK.format(bit="b.v > a.v + 1e-6", place="a.r * 8 + a.c") + """ AS x FROM small a JOIN small b ON a.id = b.id AND a.rows = 8 AND b.rows = 8 AND a.cols = 9 AND b.cols = 9 AND a.r = b.r AND b.c = a.c + 1 GROUP BY a.id)
SELECT doc_id AS id, """ + ", ".join(f"{_SIGNED.format(x=f'{n}.x')} AS {n}hash" for n in "pdw") + " FROM documents LEFT JOIN p ON p.id = doc_id LEFT JOIN d ON d.id = doc_id LEFT JOIN w ON w.id = doc_id"
)
#: Pixels of the vectors' pictures; all vectors have 64 numbers.
_PIXELS = "px AS (SELECT id, label, p // 8 AS y, p % 8 AS x, greatest(0, least(255, round(v * 255 + 128)::INT))::DOUBLE AS v FROM (SELECT vec_id AS id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"


@register(_HASHES)
def image_hashes(spark, sf_dir):
    """Perceptual, difference and wavelet hashes."""
    return I.hashes(text_pictures(spark, sf_dir)).select("id", "phash", "dhash", "whash")


_MIRROR = "CASE WHEN {i} < 0 THEN 1 WHEN {i} > 7 THEN 6 ELSE {i} END"
_SHARP = (
    "WITH " + _PIXELS + ", s AS (SELECT id, y, x, v, unnest([(-1, 0), (1, 0), (0, -1), (0, 1)]) AS d FROM px), "
    + "n AS (SELECT id, y, x, v, " + _MIRROR.format(i="y + d[1]") + " AS ny, " + _MIRROR.format(i="x + d[2]") + " AS nx FROM s), "
    + "l AS (SELECT n.id, n.y, n.x, any_value(px.label) AS label, any_value(n.v) AS g, sum(px.v) - 4 * any_value(n.v) AS lap FROM n JOIN px ON px.id = n.id AND px.y = n.ny AND px.x = n.nx GROUP BY ALL), "
    + "m AS (SELECT id, any_value(label) AS label, var_pop(lap) AS blur_score, avg(g) AS brightness, stddev_pop(g) AS contrast FROM l GROUP BY id) "
)


@register(_SHARP + "SELECT id, round(blur_score, 6) AS blur_score, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, blur_score < 100 AS is_blurry FROM m")
def image_sharpness(spark, sf_dir):
    """Blur score, brightness and contrast."""
    out = I.sharpness(vector_pictures(spark, sf_dir))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("blur_score", "brightness", "contrast")], "is_blurry")


@register(_SHARP + ", q AS (SELECT label, id, round(0.5 * blur_score + 0.3 * 64 / 1e6 + 0.2 * contrast, 6) AS score FROM m) SELECT label, arg_min(id, (-score, id)) AS best, max(score) AS score, count(*) AS n FROM q GROUP BY label".replace(", q AS", "SELECT * FROM (WITH q AS", 1) + ")")
def best_quality(spark, sf_dir):
    """The picture with the highest quality score of each label."""
    out = I.sharpness(vector_pictures(spark, sf_dir))
    score = F.round(S.quality_score("blur_score", F.col("image.width"), F.col("image.height"), "contrast"), 6)
    return groups.best_of_group(out.withColumn("score", score), "label", F.col("score"), "id")


@register()
def image_features(spark, sf_dir):
    """Feature vectors by method, in long form."""
    pictures = vector_pictures(spark, sf_dir).select(F.col("id").cast("string").alias("path"), "image")
    return I.extract_features(pictures, ("embedding", "hash", "keypoint", "histogram"))


@register("WITH " + _PIXELS + ", b AS (SELECT id, label, 73 * floor(v / 32)::INT AS bin, count(*)::DOUBLE AS n FROM px GROUP BY ALL) SELECT id, bin, round((n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE, 5) AS share FROM b")
def image_histograms(spark, sf_dir):
    """The bins of color histograms that are not empty."""
    out = I.histograms(vector_pictures(spark, sf_dir), ["id"], hsv=False)
    return out.select("id", F.posexplode("vector").alias("bin", "share")).where("share > 0").withColumn("share", F.round(F.col("share").cast("double"), 5))


@register("WITH " + _PIXELS + ", c AS (SELECT id, avg(v) AS m, list(v ORDER BY y, x) AS g FROM px GROUP BY id), k AS (SELECT id, unnest(g) - m AS v, generate_subscripts(g, 1) - 1 AS p FROM c), n AS (SELECT id, sqrt(3 * sum(v * v)) AS n FROM k GROUP BY id) SELECT k.id, (3 * p + c.c)::INT AS place, round((v / greatest(n, 1e-12))::FLOAT::DOUBLE, 5) AS x FROM k JOIN n USING (id), range(0, 3) c(c)")
def image_embeddings(spark, sf_dir):
    """Thumbnail embeddings, a row for each number."""
    out = vector_pictures(spark, sf_dir).select("id", F.posexplode(I.embedding(F.col("image"))).alias("place", "x"))
    return out.withColumn("x", F.round(F.col("x").cast("double"), 5))


_C1, _C2 = "6.5025", "58.5225"


@register(
    "WITH " + _PIXELS + ", z AS (SELECT a.id, a.y, a.x, a.v AS a, b.v AS b FROM px a JOIN px b ON b.id = a.id + 1 AND a.y = b.y AND a.x = b.x), "
    + "s AS (SELECT z.id, oy, ox, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS cv FROM z, range(0, 2) o(oy), range(0, 2) q(ox) WHERE y BETWEEN oy AND oy + 6 AND x BETWEEN ox AND ox + 6 GROUP BY ALL) "
    + f"SELECT id, round(avg((2 * ma * mb + {_C1}) * (2 * cv + {_C2}) / ((ma * ma + mb * mb + {_C1}) * (va + vb + {_C2}))), 6) AS ssim FROM s GROUP BY id"
)
def image_ssim_pairs(spark, sf_dir):
    """Structural similarity of neighbouring pictures."""
    p = vector_pictures(spark, sf_dir)
    other = p.select((F.col("id") - 1).alias("id"), F.col("image").alias("next"))
    score = I.pair_column(lambda a, b: K.ssim(a, b, None), "double")
    return p.join(other, "id").select("id", F.round(score(F.col("image"), F.col("next")), 6).alias("ssim"))


@register("WITH " + _PIXELS + ", m AS (SELECT id, avg(v) AS m FROM px GROUP BY id) SELECT a.id, false AS size_diff, false AS crop_detected, round(abs(a.m - b.m), 6) AS brightness_diff, false AS compression_diff, false AS format_diff FROM m a JOIN m b ON b.id = a.id + 1")
def image_variations(spark, sf_dir):
    """How neighbouring pictures differ."""
    p = vector_pictures(spark, sf_dir).select("id", F.col("image").alias("first"))
    other = p.select((F.col("id") - 1).alias("id"), F.col("first").alias("second"))
    return I.variations(p.join(other, "id")).drop("first", "second").withColumn("brightness_diff", F.round("brightness_diff", 6))


@register("WITH " + _PIXELS + " SELECT a.id, round(avg(abs(a.v - b.v)), 6) AS difference FROM px a JOIN px b ON b.id = a.id + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.id")
def frame_differences(spark, sf_dir):
    """Mean absolute difference of neighbouring pictures."""
    p = vector_pictures(spark, sf_dir).select("id", P.gray(F.col("image")).alias("a"))
    other = p.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return p.join(other, "id").select("id", F.round(S.mean_abs_difference("a", "b"), 6).alias("difference"))


@register(
    "WITH RECURSIVE hs AS (" + _HASHES + "), f AS (SELECT doc_id AS id, strlen(text) // 1024 AS kb, phash AS h FROM documents JOIN hs ON hs.id = doc_id WHERE strlen(text) > 0), embeddings AS (SELECT id AS vec_id FROM f), "
    + "e AS (SELECT a.id AS i, b.id AS j FROM f a JOIN f b ON a.kb = b.kb AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 5), " + LEADERS + " SELECT leader, member FROM m"
)
def image_duplicates_by_size(spark, sf_dir):
    """Duplicates by size bucket and perceptual hash."""
    return detect.by_size(text_pictures(spark, sf_dir), 5)


@register()
def image_duplicates_staged(spark, sf_dir):
    """Duplicates by the staged cascade: hash, embedding, then structure."""
    return detect.staged(text_pictures(spark, sf_dir).select("id", "image"), DuplicateSettings())


def _frames(spark, sf_dir) -> DataFrame:
    """(label, id, image, hist): pictures as the frames of a video for each label."""
    rows = vector_pictures(spark, sf_dir)
    hist = I.histograms(rows, ["id"], hsv=False, name="hist").select("id", F.transform("hist", lambda x: x.cast("double")).alias("hist"))
    return rows.join(hist, "id", "left")


_ORDERED = "o AS (SELECT vec_id AS id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)"


@register(
    "WITH " + _PIXELS + ", " + _ORDERED + ", b AS (SELECT id, floor(v / 32)::INT AS bin, count(*)::DOUBLE AS n FROM px GROUP BY ALL), "
    + "s AS (SELECT id, sum(n) AS s, sum(n * n) AS q FROM b GROUP BY id), x AS (SELECT o.id, sum(p.n * c.n) AS pc FROM o JOIN b c ON c.id = o.id JOIN b p ON p.id = o.before AND p.bin = c.bin GROUP BY o.id), "
    + "r AS (SELECT o.label, o.id, o.before, (coalesce(pc, 0) - c.s * p.s / 512) / sqrt((c.q - c.s * c.s / 512) * (p.q - p.s * p.s / 512)) AS corr FROM o LEFT JOIN x ON x.id = o.id LEFT JOIN s c ON c.id = o.id LEFT JOIN s p ON p.id = o.before) "
    + "SELECT label, id FROM r WHERE before IS NULL OR corr < 0.7"
)
def frame_scene_keyframes(spark, sf_dir):
    """Pictures whose histogram differs from that of the one before."""
    return frames.extract(_frames(spark, sf_dir), "scene", ["label"], ["id"], F.floor(F.col("id") / 1000)).select("label", "id")


@register(
    "WITH " + _PIXELS + ", " + _ORDERED + ", moves AS (SELECT dy, dx, row_number() OVER (ORDER BY dy * dy + dx * dx, dy, dx) AS k FROM range(-2, 3) a(dy), range(-2, 3) b(dx)), "
    + "cost AS (SELECT o.id, a.y // 4 AS by_, a.x // 4 AS bx, k, dy, dx, sum(abs(a.v - b.v)) AS c FROM o JOIN px a ON a.id = o.before, moves, px b WHERE b.id = o.id AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY ALL), "
    + "best AS (SELECT id, by_, bx, arg_min(sqrt(dy * dy + dx * dx), (c, k)) AS step FROM cost GROUP BY ALL), m AS (SELECT id, avg(step) AS motion FROM best GROUP BY id) "
    + "SELECT o.label, o.id, round(motion, 6) AS motion FROM o LEFT JOIN m ON m.id = o.id WHERE before IS NULL OR motion > 1.0"
)
def frame_motion_keyframes(spark, sf_dir):
    """Pictures that moved against the one before."""
    rows = vector_pictures(spark, sf_dir)
    moved = frames.extract(rows, "motion", ["label"], ["id"], F.floor(F.col("id") / 1000), threshold=1.0, block=4, reach=2)
    return moved.select("label", "id", F.round("motion", 6).alias("motion"))
