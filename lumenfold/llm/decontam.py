"""Benchmark decontamination: a broadcast hash set of normalised n-grams, scanned windows, verified hits.

DataFrame operations only.  Texts are lower-cased (A-Z) and cut into words of digits, a-z and any non-ASCII
character.  A benchmark window is `n` consecutive words of an item; an item of fewer words, but not none, is one
window.  One pass over the documents does it all: a word that is the longest of some benchmark window (its anchor)
selects the places where such windows may start; their n-grams are looked up by hash, and what is found is compared
word by word.  Windows are broadcast as numbers with their words; which items have a window is joined to the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.exact_dedup import ascii_lower
from lumenfold.llm.shared import shared_dir, small_side, stash

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One character of what separates words.
QUIET = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Windows that may be broadcast, and their bytes (words and what Spark keeps beside them); beyond either, windows meet
#: by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Columns that flag_contaminated() adds.
RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def window_key(words: Column, first: Column, size: int) -> Column:
    """Hash of every third word of a window: enough to select, as windows that meet are compared word by word."""
    at = sorted({*range(0, size, 3), size - 1})
    return F.xxhash64(F.lit(size), *[F.element_at(words, first + k + 1) for k in at])


def loud(low: Column) -> Column:
    """The words of lower-cased text: every WORD, found as what QUIET separates.  Java matches WORD, a negated
    class, at a cost that grows with the threads of an executor (four: 2.5 times the CPU seconds of one)."""
    return F.array_remove(F.split(low, f"{QUIET}+"), "")


def words_of(text: Column) -> Column:
    return loud(ascii_lower(F.coalesce(text, F.lit(""))))


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(wid, size, key, anchor, window), each distinct window once; and (wid, item).  anchor is where the longest word
    stands, the first of equals."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(n)))
    at = items.select("item", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    owned = stash(at.select("item", "size", F.slice("words", F.col("at"), F.col("size")).alias("window")).distinct(), folder, "owned")
    longest = F.array_max(F.transform("window", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"))))
    key = F.coalesce(*[F.when(F.col("size") == s, window_key(F.col("window"), F.lit(0), s)) for s in range(1, n + 1)])
    windows = owned.select("size", "window").distinct().select(F.monotonically_increasing_id().alias("wid"), "size", key.alias("key"), (-longest["i"]).alias("anchor"), "window")
    windows = stash(windows, folder, "windows")
    return windows, owned.join(windows, ["size", "window"]).select("wid", "item")


def marks(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str, broadcast_windows: int) -> DataFrame:
    """(id, fp, n_words, first, last, wid): for each document row one with n_words, and one for each occurrence of a
    benchmark window, whose words are first to last - 1."""
    sizes = [(r["size"], r["n"], r["b"]) for r in windows.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window", "")) + 24 * F.size("window") + 200).alias("b")).collect()]  # a row for each size
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), words_of(F.col(text_col)).alias("words"))
    # the null behind the words stands for the document itself
    at = base.select("id", "fp", "words", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("place", "word"))
    n_words = F.when(F.col("word").isNull(), F.col("place").cast("long")).alias("n_words")
    fits = (F.col("first") >= 0) & (F.col("first") + F.col("size") <= F.size("words"))
    part = F.slice("words", F.col("first") + 1, F.col("size"))
    key = F.coalesce(*[F.when(F.col("size") == s, window_key(F.col("words"), F.col("first"), s)) for s, *_ in sizes], F.lit(None).cast("long"))
    whole = F.col("word").isNull()
    if sum(n for _, n, _ in sizes) <= broadcast_windows and sum(b for *_, b in sizes) <= BROADCAST_BYTES:
        anchors = windows.groupBy(F.xxhash64(F.element_at("window", F.col("anchor") + 1)).alias("word_key")).agg(F.collect_set(F.struct("size", "anchor")).alias("where"))
        near = at.join(F.broadcast(anchors), F.when(~whole, F.xxhash64("word")) == F.col("word_key"), "left").where(whole | F.col("word_key").isNotNull())
        near = near.select("*", F.explode_outer("where").alias("w")).select("id", "fp", "words", "place", "word", "w.size", (F.col("place") - F.col("w.anchor")).alias("first"))
        keyed = near.where(whole | fits).withColumn("found", F.when(~whole, key))
        known = windows.select("wid", F.col("size").alias("wsize"), "key", "window")
        hits = keyed.join(F.broadcast(known), (F.col("found") == F.col("key")) & (F.col("size") == F.col("wsize")) & (part == F.col("window")), "left")
    else:  # only the window itself travels, not its document
        tried = F.array(*[F.struct(F.lit(s).alias("size")) for s, *_ in sizes]) if sizes else F.array().cast("array<struct<size:int>>")
        near = at.select("*", F.explode_outer(F.when(~whole, tried)).alias("w")).select("id", "fp", "words", "place", "word", "w.size", F.col("place").alias("first"))
        keyed = near.where(whole | fits).select("id", "fp", "place", "word", "size", "first", F.when(~whole, key).alias("key"), F.when(~whole, part).alias("window"))
        hits = keyed.join(windows.select("wid", "size", "key", "window"), ["key", "size", "window"], "left")
    hits = hits.where(whole | F.col("wid").isNotNull())
    return hits.select("id", "fp", n_words, F.when(~whole, F.col("first")).alias("first"), F.when(~whole, F.col("first") + F.col("size")).alias("last"), "wid")


def verdicts(docs: DataFrame, benchmark: DataFrame, *, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(id, fp, copies) and RESULT, a row for each distinct id and text (fp is the text's hash) of docs."""
    folder = shared_dir(docs.sparkSession)
    windows, owned = benchmark_windows(benchmark, n, item_col, item_text_col, folder)
    found = marks(docs, windows, id_col, text_col, broadcast_windows).groupBy("id", "fp").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("wid").isNotNull(), F.struct("first", "last")))).alias("spans"), F.collect_set("wid").alias("wids"),
    )
    start = F.array().cast("array<struct<first:int,last:int>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["first"] <= last["last"], longer).otherwise(F.concat(done, F.array(s)))

    found = stash(found.withColumn("hit_spans", F.aggregate("spans", start, merge)).drop("spans"), folder, "found")
    items = found.select("id", "fp", F.explode("wids").alias("wid")).join(owned, "wid").groupBy(F.col("id").alias("owner"), F.col("fp").alias("owner_fp")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.join(items, F.col("id").eqNullSafe(F.col("owner")) & (F.col("fp") == F.col("owner_fp")), "left")
    out = out.withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"]))
    out = out.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})
    return out.select("id", "fp", "copies", *RESULT)


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs plus n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words) and
    hit_spans (merged word ranges, first included, last excluded).  Options are those of verdicts().

    Null or empty text has no words and is clean; null item ids count as ''; empty tables give no hits or no rows.
    Repeated rows each get the verdict of their own id and text.  Very long texts are scanned whole.
    Columns of docs keep their names; input columns named like a result column are replaced.
    """
    docs = docs.drop(*RESULT)
    said = verdicts(docs, benchmark, **how)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(how.get("id_col", "doc_id")).alias("id"), F.xxhash64(how.get("text_col", "text")).alias("fp"))
    return rows.join(said, rows["id"].eqNullSafe(said["id"]) & (rows["fp"] == said["fp"])).select("row.*", *RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones: only the ids of those travel, no text."""
    said = small_side(verdicts(docs, benchmark, **how).where("contaminated").select("id", "fp"))
    on = F.col(f"`{how.get('id_col', 'doc_id')}`").eqNullSafe(said["id"]) & (F.xxhash64(how.get("text_col", "text")) == said["fp"])
    return docs.join(said, on, "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", **how) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with the hit words of every document cut out
    together with what follows them up to the next word (mode "spans").  Columns stay as they are."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode must be documents or spans, not {mode!r}")
    text_col, columns = how.get("text_col", "text"), docs.columns
    if mode == "documents":
        return clean(docs, benchmark, **how)
    flagged = flag_contaminated(docs, benchmark, **how)
    loud = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before lower-casing
    quiet = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({loud}{quiet})"), F.lit(1))
    kept = F.filter(pieces, lambda piece, i: ~F.exists("hit_spans", lambda s: (i >= s["first"]) & (i < s["last"])))
    cut = F.concat(F.regexp_extract(text_col, f"^{quiet}", 0), F.array_join(kept, ""))
    return flagged.withColumn(text_col, F.when(F.col("n_hit") > 0, cut).otherwise(F.col(text_col))).select(*columns)


def op7(spark, sf_dir: str) -> DataFrame:
    """op7_decontamination: one row per document."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    said = verdicts(docs, benchmark)
    rows = said.select(F.col("id").alias("doc_id"), *RESULT[:-1], F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select("doc_id", *RESULT[:-1])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
