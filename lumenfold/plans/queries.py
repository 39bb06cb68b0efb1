"""Queries over the driver's tables, each with the SQL that gives the same rows.

Vectors are `embeddings`; files are `documents`, `pages`, `orders`; frame sequences are `events` by user, whose value
is the frame's signal; metric records are `events` by type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import scalars as S
from lumenfold.operators import cells, cluster, frames, groups, hamming, ordered, stats, stored_index, vectors
from lumenfold.plans.image_queries import LEADERS
from lumenfold.sources.catalog import Catalog
from lumenfold.sources.tables import working_folder

AS_OF = "1999-01-01 00:00:00"
REGISTERED: dict[str, tuple] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def add(query):
        REGISTERED[query.__name__] = (query, sql)
        return query

    return add


def _queries(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where(F.col("vec_id") % 100 == 0)


# ---- search

_KNN = """
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {measure} AS d
           FROM embeddings q, embeddings v WHERE {which}),
r AS (SELECT query_id, id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, id, round({similarity}, 6) AS similarity FROM r WHERE rank <= {k}
"""
_L2 = "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_COS = "-list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _rounded(neighbours: DataFrame) -> DataFrame:
    return neighbours.withColumn("similarity", S.rounded("similarity", 6))


@register(_KNN.format(measure=_L2, which="q.vec_id = 0", similarity="1 / (1 + d)", k=10))
def knn_l2_topk(spark, sf_dir):
    """The ten nearest vectors of vector 0."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(vectors.knn_join(v, v.where("vec_id = 0"), 10))


@register(_KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=10))
def knn_batch(spark, sf_dir):
    """The ten nearest of every hundredth vector, against all."""
    return _rounded(vectors.knn_join(*_queries(spark, sf_dir), 10))


@register(_KNN.format(measure=_COS, which="q.vec_id % 100 = 0", similarity="-d", k=10))
def knn_cosine_topk(spark, sf_dir):
    """The ten most similar by cosine of every hundredth vector."""
    return _rounded(vectors.knn_join(*_queries(spark, sf_dir), 10, metric="cosine"))


@register("SELECT * FROM (" + _KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=10) + ") WHERE similarity >= 0.4")
def knn_threshold_after_topk(spark, sf_dir):
    """A similarity threshold on what top-k has left."""
    return vectors.above_threshold(_rounded(vectors.knn_join(*_queries(spark, sf_dir), 10)), 0.4)


@register(_KNN.format(measure=_L2, which="true", similarity="1 / (1 + d)", k=5))
def knn_self_join(spark, sf_dir):
    """The five nearest of every vector, by cells."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(cells.knn_cells(v, v, 5))


@register(_KNN.format(measure=_COS, which="true", similarity="-d", k=3))
def knn_self_join_cosine(spark, sf_dir):
    """The three most similar by cosine of every vector, by cells."""
    v = table(spark, sf_dir, "embeddings")
    return _rounded(cells.knn_cells(v, v, 3, metric="cosine"))


@register(_KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=5))
def ivf_full_probe(spark, sf_dir):
    """Search by inverted cells, looking into all of them: exact."""
    return _rounded(vectors.ivf_search(*_queries(spark, sf_dir), 5, n_cells=8, probes=8))


@register()
def ivf_search(spark, sf_dir):
    """Search by inverted cells, looking into 12 of 16."""
    return vectors.ivf_search(*_queries(spark, sf_dir), 10, n_cells=16, probes=12)


@register("SELECT query_id, string_agg(printf('%d. %d (%.1f%%)', rank, id, round(similarity * 100, 1)), '; ' ORDER BY rank) AS lines FROM (" + _KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=3) + ") GROUP BY query_id")
def ranked_lines(spark, sf_dir):
    """Search results as one line of text for each query."""
    near = _rounded(vectors.knn_join(*_queries(spark, sf_dir), 3))
    line = F.format_string("%d. %d (%.1f%%)", "rank", "id", S.rounded(F.col("similarity") * 100, 1))
    return near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "; ").alias("lines"))


@register("SELECT n.query_id, n.rank, n.id, p.url AS path FROM (" + _KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=10) + ") n JOIN pages p ON p.page_id = n.id")
def neighbour_paths(spark, sf_dir):
    """Search results with the paths of what was found."""
    paths = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))
    return vectors.knn_join(*_queries(spark, sf_dir), 10).join(paths, "id").select("query_id", "rank", "id", "path")


@register(_KNN.format(measure=_L2, which="q.vec_id % 100 = 0", similarity="1 / (1 + d)", k=5))
def index_growth(spark, sf_dir):
    """Search by an index that was stored of nine tenths of the vectors, with the others added, some of them in place of
    former ones, and a cell split; all cells are looked into."""
    v, queries = _queries(spark, sf_dir)
    folder = working_folder(spark) + "/index"
    former = v.where("vec_id % 10 = 4").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    stored_index.create(v.where("vec_id % 10 < 4 or vec_id % 10 > 5").unionByName(former, allowMissingColumns=True), folder, n_cells=8)
    stored_index.add(v.where("vec_id % 10 = 4 or vec_id % 10 = 5"), folder, most=max(1, v.count() // 4))
    indexed, centres = stored_index.read(spark, folder)
    return _rounded(vectors.search_cells(indexed, centres, queries, 5, probes=len(centres)))


@register()
def index_codes_search(spark, sf_dir):
    """Search by codes of a byte for two numbers; the best 100 of each query are measured exactly."""
    v, queries = _queries(spark, sf_dir)
    folder = working_folder(spark) + "/index"
    stored_index.create(v, folder, n_cells=16, parts=32)
    return _rounded(stored_index.search_codes(spark, folder, queries, 10, probes=14))


@register("SELECT vec_id AS image_id, concat('label', label) AS feature_type, len(embedding) AS n, round(CASE WHEN vec_id % 10 = 0 THEN embedding[-1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings")
def catalog_upserts(spark, sf_dir):
    """Features of the catalog after all vectors were put in, and every tenth once more with another value, twice."""
    catalog = Catalog(spark, working_folder(spark))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("label"), "label").alias("feature_type"), F.col("embedding").alias("feature_vector"))
    catalog.cache_features(rows)
    for _ in range(2):
        catalog.cache_features(rows.where("image_id % 10 = 0").withColumn("feature_vector", F.reverse("feature_vector")))
    return catalog.read("features").select("image_id", "feature_type", F.size("feature_vector").cast("long").alias("n"), F.round(F.col("feature_vector")[0].cast("double"), 6).alias("first"))


# ---- similarity joins and clusters

_EDGES = "e AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {t})"
@register("WITH " + _EDGES.format(t=0.3) + " SELECT i, j, round(s, 6) AS similarity FROM e")
def cosine_pairs(spark, sf_dir):
    """All pairs of vectors with a cosine of 0.3 or more."""
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), 0.3).withColumn("similarity", F.round("similarity", 6))


@register("WITH embeddings AS (SELECT min(vec_id) AS vec_id, embedding FROM embeddings GROUP BY embedding), " + _EDGES.format(t=0.5) + " SELECT i, j, round(s, 6) AS similarity FROM e")
def cosine_class_pairs(spark, sf_dir):
    """All pairs of different vectors with a cosine of 0.5 or more, each by the least id of its copies."""
    pairs, _ = cells.similar_classes(table(spark, sf_dir, "embeddings"), 0.5)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@register("WITH " + _EDGES.format(t=0.3) + " SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.i = v.vec_id OR e.j = v.vec_id) AS n_links FROM embeddings v")
def cosine_link_counts(spark, sf_dir):
    """For each vector, how many others are similar."""
    return cells.link_counts(table(spark, sf_dir, "embeddings"), 0.3).withColumnRenamed("id", "vec_id")


@register("SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.25")
def cosine_pairs_in_group(spark, sf_dir):
    """Similar pairs within candidate groups."""
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), 0.25, group="label").withColumn("similarity", F.round("similarity", 6))


@register("WITH RECURSIVE " + _EDGES.format(t=0.3) + ", " + LEADERS + " SELECT v.vec_id, coalesce(m.leader, v.vec_id) AS leader FROM embeddings v LEFT JOIN m ON m.member = v.vec_id")
def leader_clusters(spark, sf_dir):
    """Greedy leader clustering by cosine: each vector's leader."""
    v = table(spark, sf_dir, "embeddings")
    return cluster.with_leaders(v.select("vec_id"), cells.class_leaders(*cells.similar_classes(v, 0.3)), id_col="vec_id")


@register("WITH RECURSIVE " + _EDGES.format(t=0.3) + ", " + LEADERS + " SELECT leader, count(*) + 1 AS size FROM m GROUP BY leader")
def leader_clusters_min2(spark, sf_dir):
    """Sizes of the clusters that have two members or more."""
    return cluster.group_sizes(cells.class_leaders(*cells.similar_classes(table(spark, sf_dir, "embeddings"), 0.3)))


@register()
def lsh_pairs(spark, sf_dir):
    """Similar pairs by random hyperplanes; approximate."""
    return vectors.lsh_pairs(table(spark, sf_dir, "embeddings"), 0.4)


# ---- hashes

_BITS = "array_to_string(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > list_median(embedding::DOUBLE[]) THEN '1' ELSE '0' END), '')"


@register(f"SELECT vec_id, {_BITS} AS bits FROM embeddings")
def median_bits(spark, sf_dir):
    """64-bit hashes: each element against the median of its vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", S.median_bits("embedding").alias("bits"))


def _hashes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", "label", S.bits_to_long(S.median_bits("embedding")).alias("hash"))


_COPIES = "SELECT r AS i, vec_id AS j, 0::INT AS distance FROM c JOIN h USING ({keys}) WHERE vec_id <> r"


@register(f"WITH h AS (SELECT vec_id, {_BITS} AS b FROM embeddings), c AS (SELECT b, min(vec_id) AS r FROM h GROUP BY b) SELECT x.r AS i, y.r AS j, hamming(x.b, y.b)::INT AS distance FROM c x JOIN c y ON x.r < y.r WHERE hamming(x.b, y.b) <= 18 UNION ALL " + _COPIES.format(keys="b"))
def hamming_pairs(spark, sf_dir):
    """Classes of equal hashes that differ in 18 bits at most, and the members of each class."""
    return hamming.near_links(_hashes(spark, sf_dir), 18, id_col="vec_id")


@register(f"WITH h AS (SELECT vec_id, label, {_BITS} AS b FROM embeddings), c AS (SELECT b, label, min(vec_id) AS r FROM h GROUP BY b, label) SELECT x.r AS i, y.r AS j, hamming(x.b, y.b)::INT AS distance FROM c x JOIN c y ON x.r < y.r AND x.label = y.label WHERE hamming(x.b, y.b) <= 20 UNION ALL " + _COPIES.format(keys="b, label"))
def blocked_hamming_pairs(spark, sf_dir):
    """Classes within a bucket that differ in 20 bits at most, and the members of each class."""
    return hamming.near_links(_hashes(spark, sf_dir), 20, id_col="vec_id", bucket="label")


@register(f"WITH h AS (SELECT vec_id, {_BITS} AS b FROM embeddings), c AS (SELECT b, min(vec_id) AS r FROM h GROUP BY b) SELECT x.r AS i, y.r AS j, hamming(x.b, y.b)::INT AS distance FROM c x JOIN c y ON x.r < y.r WHERE hamming(x.b, y.b) <= 16")
def hamming_cell_pairs(spark, sf_dir):
    """Classes of equal hashes that differ in 16 bits at most, by cells of six bands whose bits are near."""
    reps = hamming.classes(_hashes(spark, sf_dir), "hash", "vec_id")
    return hamming.cell_pairs(reps, 16, hamming.near_bands(16, 64, 6))


_PREFIX = "('0x' || substr(md5(text), 1, 4))::INT"


@register(f"WITH h AS (SELECT DISTINCT {_PREFIX} AS h FROM documents), c AS (SELECT {_PREFIX} AS h, min(doc_id) AS r FROM documents GROUP BY 1) SELECT least(x.r, y.r) AS i, greatest(x.r, y.r) AS j, bit_count(xor(x.h, y.h))::INT AS distance FROM c x JOIN c y ON x.r < y.r WHERE bit_count(xor(x.h, y.h)) <= 1")
def hamming_band_pairs(spark, sf_dir):
    """Classes of equal 16-bit content hashes that differ in one bit at most, by bands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("long").alias("hash"))
    return hamming.near_pairs(docs, 1, id_col="doc_id", bits=16)


# ---- duplicate groups

_DUPS = "g AS (SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS rep FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1), m AS (SELECT d.doc_id, d.text, d.source, g.k, g.rep, g.n FROM documents d JOIN g ON md5(d.text) = g.k)"


def _members(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return groups.members(docs, F.md5("text"), "doc_id").withColumn("bytes", F.octet_length("text").cast("long"))


@register("WITH " + _DUPS + " SELECT k AS content_hash, n, rep AS representative FROM g")
def exact_hash_groups(spark, sf_dir):
    """Groups of equal content and their smallest ids."""
    return groups.exact_groups(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id").select(F.col("key").alias("content_hash"), "n", "representative")


@register("SELECT (strlen(text) // 1024) * 1024 AS kb_bucket, count(*) AS bucket_n FROM documents WHERE strlen(text) > 0 GROUP BY 1 HAVING count(*) > 1")
def size_buckets(spark, sf_dir):
    """KiB buckets with two files or more."""
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.octet_length("text"))
    return docs.where("bytes > 0").groupBy(S.kb_bucket("bytes").alias("kb_bucket")).agg(F.count("*").alias("bucket_n")).where("bucket_n > 1")


@register("SELECT doc_id, (strlen(text) // 1024) * 1024 AS kb_bucket, count(*) OVER (PARTITION BY strlen(text) // 1024) AS bucket_n FROM documents WHERE strlen(text) > 0 QUALIFY count(*) OVER (PARTITION BY strlen(text) // 1024) > 1")
def size_block_rows(spark, sf_dir):
    """The files of crowded KiB buckets: what is left to hash."""
    docs = table(spark, sf_dir, "documents").withColumn("bytes", F.octet_length("text"))
    return groups.size_blocks(docs, "bytes").select("doc_id", "kb_bucket", "bucket_n")


@register("WITH " + _DUPS + " SELECT doc_id, rep AS representative, n FROM m")
def representative_min(spark, sf_dir):
    """Members of duplicate groups and the smallest id of each."""
    return _members(spark, sf_dir).select("doc_id", "representative", "n")


@register("WITH " + _DUPS + " SELECT rep AS representative, doc_id AS duplicate FROM m WHERE doc_id <> rep")
def dup_edges(spark, sf_dir):
    """Representative and duplicate, a row each."""
    return groups.edges(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")


@register("WITH " + _DUPS + ", e AS (SELECT rep, doc_id FROM m WHERE doc_id <> rep), s AS (SELECT rep, ceil(count(*) / 2.0)::BIGINT AS c FROM e GROUP BY rep) SELECT e.rep AS representative, e.doc_id % s.c AS chunk, string_agg(e.doc_id::VARCHAR, ',' ORDER BY e.doc_id) AS duplicates FROM e JOIN s USING (rep) GROUP BY e.rep, e.doc_id % s.c")
def group_members_array(spark, sf_dir):
    """Duplicates of each representative, as arrays of about two."""
    chunks = groups.arrays(groups.edges(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id"), chunk=2)
    return chunks.select("representative", "chunk", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"))


@register("WITH " + _DUPS + " SELECT count(DISTINCT rep) AS n_groups, count(*) FILTER (doc_id <> rep) AS n_duplicates, coalesce(sum(strlen(text)) FILTER (doc_id <> rep), 0)::BIGINT AS bytes_saved FROM m")
def space_savings(spark, sf_dir):
    """Bytes of all duplicates but the representatives."""
    return groups.space_savings(_members(spark, sf_dir), "representative", "representative", "doc_id", "bytes")


@register("WITH " + _DUPS + " SELECT rep AS representative, count(*) AS n, sum(strlen(text))::BIGINT AS total_bytes, max(strlen(text))::BIGINT AS largest FROM m GROUP BY rep")
def group_summary(spark, sf_dir):
    """Count and bytes of each duplicate group."""
    return groups.group_summary(_members(spark, sf_dir), "representative", "bytes")


@register("WITH " + _DUPS + " SELECT to_json({representative: rep, duplicates: n - 1})::VARCHAR AS line FROM g")
def group_json(spark, sf_dir):
    """Groups as JSON records."""
    found = groups.exact_groups(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")
    return found.select(F.to_json(F.struct("representative", (F.col("n") - 1).alias("duplicates"))).alias("line"))


_ORDERS = "SELECT o_orderkey, o_custkey, (o_totalprice * 1000)::BIGINT AS bytes, 1000 + o_orderkey % 1000 AS w, 800 AS h, CASE o_orderstatus WHEN 'F' THEN 'png' WHEN 'O' THEN 'jpg' ELSE 'gif' END AS ext, o_orderdate AS t FROM orders"
_SCORE = "bytes / 1048576.0 + w::DOUBLE * h / 1e6 + CASE ext WHEN 'png' THEN 10.0 WHEN 'jpg' THEN 5.0 ELSE 0.0 END + floor((epoch(TIMESTAMP '1999-01-01') - epoch(t)) / 86400) / 365.0"


def _files(spark, sf_dir):
    ext = F.when(F.col("o_orderstatus") == "F", "png").when(F.col("o_orderstatus") == "O", "jpg").otherwise("gif")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 1000).cast("long").alias("bytes"), (1000 + F.col("o_orderkey") % 1000).alias("w"), F.lit(800).alias("h"), F.concat(F.lit("/img/"), F.col("o_orderkey").cast("string"), F.lit("."), ext).alias("path"), F.col("o_orderdate").alias("t"))


def _score():
    return F.round(S.representative_score("bytes", "w", "h", "path", "t", AS_OF), 6)


@register(f"WITH o AS ({_ORDERS}), s AS (SELECT *, round({_SCORE}, 6) AS score FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM s) SELECT o_custkey, o_orderkey AS best, score, n FROM r WHERE k = 1")
def best_of_group(spark, sf_dir):
    """The copy to keep in each group."""
    return groups.best_of_group(_files(spark, sf_dir), "o_custkey", _score(), "o_orderkey")


@register(f"WITH o AS ({_ORDERS}), s AS (SELECT *, round({_SCORE}, 6) AS score FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS k FROM s) SELECT count(DISTINCT o_custkey) AS processed_groups, count(*) AS files_deleted, sum(bytes)::BIGINT AS space_saved FROM r WHERE k > 1")
def clean_plan_dry_run(spark, sf_dir):
    """What cleaning all groups would delete and free."""
    return groups.clean_summary(groups.clean_plan(_files(spark, sf_dir), "o_custkey", _score(), "o_orderkey"), "o_custkey", "bytes")


@register("WITH " + _DUPS + ", b AS (SELECT rep, doc_id AS id FROM m), l AS (SELECT * FROM b WHERE id % 3 <> 0), f AS (SELECT rep, CASE WHEN bool_or(id = rep) THEN rep ELSE min(id) END AS fresh FROM l GROUP BY rep) SELECT f.fresh AS representative, l.id AS duplicate FROM l JOIN f USING (rep) WHERE l.id <> f.fresh")
def group_after_delete(spark, sf_dir):
    """Groups after a third of the files has gone."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    return groups.after_delete(groups.edges(docs, F.md5("text"), "doc_id"), gone)


# ---- catalog

@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_indexed(spark, sf_dir):
    """Files that the catalog doesn't have yet."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("SELECT d.doc_id, l.quality IS NOT NULL AS cached, coalesce(l.quality, -1) AS feature FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_lookup(spark, sf_dir):
    """Cached features, and which must be computed."""
    out = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", F.col("quality").isNotNull().alias("cached"), F.coalesce("quality", F.lit(-1)).alias("feature"))


@register("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    """The latest version of each key."""
    from lumenfold.sources import catalog

    return catalog.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@register("SELECT count(*) AS n, coalesce(sum(strlen(html)), 0)::BIGINT AS total_bytes FROM pages")
def catalog_stats(spark, sf_dir):
    """Number and bytes of catalog entries."""
    return stats.catalog_stats(table(spark, sf_dir, "pages").withColumn("bytes", F.octet_length("html").cast("long")), "bytes")


@register("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf_dir):
    """Distinct catalog keys."""
    return table(spark, sf_dir, "documents").select("source").distinct()


@register("SELECT user_id, max_by(event_id, (ts, event_id)) AS newest FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def restore_lookup(spark, sf_dir):
    """The newest entry of each name in an operation log."""
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@register("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' - INTERVAL 1000 DAY")
def trash_to_empty(spark, sf_dir):
    """Entries older than a number of days."""
    return table(spark, sf_dir, "orders").where(S.older_than("o_orderdate", AS_OF, 1000)).select("o_orderkey")


# ---- frames

_FRAMES = "f AS (SELECT user_id, event_id, ts, value, row_number() OVER w - 1 AS frame_idx, lag(value) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
_ORDER = ["ts", "event_id"]


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")


def _day():
    return ordered.day_bucket("ts")


@register("WITH " + _FRAMES + " SELECT user_id, event_id, frame_idx FROM f WHERE frame_idx % 30 = 0")
def keyframes_uniform(spark, sf_dir):
    """Every thirtieth frame."""
    numbered = ordered.with_index(_frames(spark, sf_dir), ["user_id"], _ORDER, _day())
    return frames.uniform_keyframes(numbered).select("user_id", "event_id", "frame_idx")


@register("WITH " + _FRAMES + " SELECT user_id, event_id FROM f WHERE prev IS NULL OR abs(value - prev) > 30")
def keyframes_delta(spark, sf_dir):
    """First frames, and frames that differ from the one before."""
    return frames.change_keyframes(_frames(spark, sf_dir), ["user_id"], _ORDER, "value", _day(), lambda p, c: F.abs(c - p) > 30).select("user_id", "event_id")


@register("WITH " + _FRAMES + ", s AS (SELECT user_id, frame_idx, sum(CASE WHEN abs(value - prev) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_idx) AS scene_no FROM f) SELECT user_id, scene_no::BIGINT AS scene_no, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame FROM s GROUP BY ALL")
def scene_segments(spark, sf_dir):
    """Runs of frames between cuts."""
    return frames.scene_segments(_frames(spark, sf_dir), ["user_id"], _ORDER, "value", _day(), cut=lambda p, c: F.abs(c - p) > 30)


@register("WITH " + _FRAMES + ", m AS (SELECT user_id, count(*) // 2 AS mid FROM f GROUP BY 1) SELECT f.user_id, f.event_id, f.frame_idx FROM f JOIN m ON f.user_id = m.user_id AND f.frame_idx = m.mid")
def frame_middle(spark, sf_dir):
    """The middle frame of each sequence."""
    numbered = ordered.with_index(_frames(spark, sf_dir), ["user_id"], _ORDER, _day())
    return frames.middle_frames(numbered, ["user_id"]).select("user_id", "event_id", "frame_idx")


@register("SELECT user_id, floor(2.5 * 12)::BIGINT AS at_time, count(*) // 2 AS by_default FROM events GROUP BY user_id")
def seek_frame(spark, sf_dir):
    """The frame at 2.5 s of 12 frames a second, and the default."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", S.seek_frame(F.lit(2.5), F.lit(12.0), "n").alias("at_time"), S.seek_frame(None, F.lit(12.0), "n").alias("by_default"))


@register("SELECT label, (dim - 1)::INT AS dim, round(avg(x), 6) AS mean_value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def mean_pool_embedding(spark, sf_dir):
    """Mean embedding of each label."""
    return frames.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumn("mean_value", F.round("mean_value", 6))


@register("SELECT label, (dim - 1)::INT AS dim, round(avg(x), 6) AS mean_value, round(stddev_pop(x), 6) AS std_value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim")
def descriptor_stats(spark, sf_dir):
    """Mean and deviation of each dimension."""
    out = frames.descriptor_stats(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.withColumns({"mean_value": F.round("mean_value", 6), "std_value": F.round("std_value", 6)})


_POOLED = "p AS (SELECT label, list(m ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label)"


@register("WITH " + _POOLED + ", d AS (SELECT q.label::BIGINT AS query_id, v.label::BIGINT AS id, list_cosine_similarity(q.v, v.v) AS s FROM p q JOIN p v ON q.label % 3 = 0) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank, id, round(s, 6) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5")
def similar_sequences(spark, sf_dir):
    """Sequences most similar by pooled embedding."""
    pooled = frames.pooled_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select(F.col("label").cast("long").alias("label"), "vector")
    return _rounded(vectors.knn_join(pooled, pooled.where("label % 3 = 0"), 5, id_col="label", vector="vector", metric="cosine"))


@register("SELECT a.vec_id, round(corr_v, 6) AS corr, round(chi_v, 4) AS chisqr, round(inter_v, 6) AS intersect FROM (SELECT a.vec_id, (SELECT corr(x, y) FROM (SELECT unnest(a.h) AS x, unnest(b.h) AS y)) AS corr_v, (SELECT sum(CASE WHEN x <> 0 THEN (x - y) * (x - y) / x ELSE 0 END) FROM (SELECT unnest(a.h) AS x, unnest(b.h) AS y)) AS chi_v, (SELECT sum(least(x, y)) FROM (SELECT unnest(a.h) AS x, unnest(b.h) AS y)) AS inter_v FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 1 + abs(x)) AS h FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 1 + abs(x)) AS h FROM embeddings) b ON b.vec_id = a.vec_id + 1) a")
def histogram_compare(spark, sf_dir):
    """Correlation, chi-square and intersection of neighbouring histograms."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(S.doubles("embedding"), lambda x: 1 + F.abs(x)).alias("h"))
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g"))
    both = h.join(other, "vec_id")
    return both.select("vec_id", F.round(S.histogram_correlation("h", "g"), 6).alias("corr"), F.round(S.histogram_chi_square("h", "g"), 4).alias("chisqr"), F.round(S.histogram_intersection("h", "g"), 6).alias("intersect"))


# ---- statistics and scalars

@register("SELECT event_type, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, min(value) AS min_value, max(value) AS max_value, round(stddev_pop(value), 6) AS std_value, round(sum(value), 3) AS total_value, count(value) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def metric_stats(spark, sf_dir):
    """Statistics of durations by operation."""
    out = stats.operation_stats(table(spark, sf_dir, "events"), operation="event_type", duration="value")
    return out.select("event_type", F.round("mean_value", 6).alias("mean_value"), F.round("median_value", 6).alias("median_value"), "min_value", "max_value", F.round("std_value", 6).alias("std_value"), F.round("total_value", 3).alias("total_value"), "n")


@register("WITH r AS (SELECT min(list_min(embedding::DOUBLE[])) AS lo, max(list_max(embedding::DOUBLE[])) AS hi FROM embeddings) SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: round((x - lo) / (hi - lo) * 255)::INT), ',') AS codes FROM embeddings, r")
def quantize_u8(spark, sf_dir):
    """Vectors as 8-bit codes."""
    out = vectors.quantized(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@register("SELECT round(min(list_min(embedding::DOUBLE[])), 6) AS low, round(max(list_max(embedding::DOUBLE[])), 6) AS high FROM embeddings")
def value_range(spark, sf_dir):
    """Least and largest element."""
    return vectors.value_range(table(spark, sf_dir, "embeddings")).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("SELECT event_type, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value, round(sum(value), 3) AS total_value, round(count(value) / sum(value), 6) AS per_second FROM events GROUP BY event_type")
def throughput(spark, sf_dir):
    """Mean and total of durations, and calls a second, by operation."""
    out = stats.throughput(table(spark, sf_dir, "events"), operation="event_type", duration="value")
    return out.select("event_type", *[F.round(c, d).alias(c) for c, d in (("mean_value", 6), ("std_value", 6), ("total_value", 3), ("per_second", 6))])


_UNITS = "CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) ELSE printf('%.2f MB', b / 1048576.0) END"


@register(f"SELECT doc_id, {_UNITS} AS size_text FROM (SELECT doc_id, strlen(text)::DOUBLE AS b FROM documents)")
def human_size(spark, sf_dir):
    """Sizes for people."""
    return table(spark, sf_dir, "documents").select("doc_id", S.human_size(F.octet_length("text")).alias("size_text"))


@register(r"SELECT page_id, regexp_replace(regexp_replace(url, '[/\\]', '_', 'g'), '[^\w\s.-]', '', 'g') AS safe_name, CASE WHEN length(url) > 20 THEN substr(url, 1, 17) || '...' ELSE url END AS short_name, regexp_extract(url, '([^/]*)$', 1) AS file_name FROM pages")
def sanitize_names(spark, sf_dir):
    """Safe, short and bare file names."""
    return table(spark, sf_dir, "pages").select("page_id", S.sanitize_filename("url").alias("safe_name"), S.ellipsis("url").alias("short_name"), S.file_name("url").alias("file_name"))


@register("SELECT o_orderkey, floor((epoch(TIMESTAMP '1999-01-01') - epoch(o_orderdate)) / 86400)::BIGINT AS age, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders")
def age_and_stamp(spark, sf_dir):
    """Age in whole days, and a file-name time stamp."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.age_days("o_orderdate", AS_OF).alias("age"), S.stamp("o_orderdate").alias("stamp"))


@register(f"WITH o AS ({_ORDERS}) SELECT ext, count(*) AS n, count(*) FILTER (ext IN ('png', 'jpg') AND bytes <= 52428800) AS valid FROM o GROUP BY ext")
def valid_files(spark, sf_dir):
    """Files with an allowed extension and size."""
    files = _files(spark, sf_dir).withColumn("ext", S.extension("path"))
    good = S.is_valid_image("path", "bytes") & (F.col("ext") != "gif")
    return files.groupBy("ext").agg(F.count("*").alias("n"), F.count(F.when(good, 1)).alias("valid"))


@register()
def pca_components(spark, sf_dir):
    """Eight principal components of each vector."""
    return vectors.pca(table(spark, sf_dir, "embeddings"), 8)
