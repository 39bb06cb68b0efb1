"""The numbered operators against brute force, round trips and planted cases, on small inputs."""

import hashlib
import math
import tracemalloc
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import cotrain, decontam, exact_dedup, langid, minhash, packing, queries, shared, substring_dedup, suffix_dedup, textnp, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r)))


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "   ", base, base, base.upper(), base + " tail", "é ü 漢字 😀 " * 9, "one two", "one two", "x" * 5000 + " " + base, "\t\n\x0b\x0c\r .,;", base]
    rows = [(i if i != 5 else None, t, "en", "s", 1, 7, "r", 0.5, True, "k", 1, 2) for i, t in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(rows, DOCS + ", id long, row string, score double, kept boolean, key string, n_words long, component_id long")


# ---- 1

@pytest.mark.parametrize("how", [{}, {"capacity": 3, "max_depth": 8}, {"key": lambda c: F.shiftleft(F.length(c).cast("long"), 50), "capacity": 5}])
def test_exact_dedup_equals_sql(spark, sf_dir, documents, how):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(c.sql(exact_dedup.ORACLE).fetchall(), key=lambda r: tuple(map(str, r)))
    assert rows_of(exact_dedup.verdicts(documents, **how)) == want


def test_exact_dedup_odd_rows(odd):
    out = exact_dedup.exact_dedup(odd)
    got = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert got[0, None]["keep_id"] == 1 and got[1, ""]["kept"] and got[1, ""]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[3, got[4, odd.where("doc_id = 4").first()["text"]]["text"]]["keep_id"] == 12
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(4096).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(keys, 100, 10).collect()
    assert sum(r["n"] for r in leaves) == 4096 and max(r["n"] for r in leaves) <= 100
    assert sum(2.0 ** -r["depth"] for r in leaves) == 1


# ---- 2

def test_quality(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = cotrain.classify_quality(docs, labels, rounds=1).join(labels, "doc_id").toPandas()
    held = got[[crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    assert ((held["quality_score"] >= 0.5) == (held["quality"] == 1)).mean() >= 0.95
    assert got["quality_score"].between(0, 1).all()


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_quality_equals_brute_force(spark, rounds):
    """A page's host tells as much as its words, so that either view teaches the other."""
    rng = np.random.default_rng(4)
    docs = []
    for i in range(120):
        good = i % 2
        own = rng.choice([f"w{k}" for k in range(9)] if rng.random() < 0.85 else [f"J{k}" for k in range(9)], 12) if good else rng.choice([f"J{k}" for k in range(9)], 9)
        host = f"h{rng.integers(2) + 2 * (good if rng.random() < 0.85 else 1 - good)}.org"
        docs.append((i, " ".join(own) + "\n" * int(rng.integers(3)) if i != 7 else None, ["a", "b"][int(rng.integers(2))], "en", int(rng.integers(10, 99)), f"http://{host}/x/y" if i % 11 else None))
    labels = {i: i % 2 for i in range(0, 120) if i % 3}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long, url string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    want, pseudo = cotrain.brute_force(docs, labels, rounds, 0.8)
    got = {r["doc_id"]: r for r in cotrain.classify_quality(df, known, rounds=rounds, sure=0.8).collect()}
    assert len(got) == 120 and (pseudo > 20) == (rounds > 0)
    for i, *scores in want:
        assert np.allclose([got[i][c] for c in ("text_score", "meta_score", "quality_score")], scores, atol=1e-6), i
        assert got[i]["kept"] == (scores[2] >= 0.5)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (99, 1)], "doc_id long, quality int")
    out = cotrain.classify_quality(odd, labels, rounds=1)
    assert out.count() == odd.count() and out.where("quality_score is null").count() == 0
    assert cotrain.classify_quality(odd.select("doc_id", "text").limit(0), labels.limit(0), rounds=1).count() == 0


def test_quality_holds_one_chunk_of_a_batch(monkeypatch):
    """A batch of twelve chunks takes little more memory than a batch of one, in training and in scoring."""
    monkeypatch.setattr(textnp, "CHUNK", 1 << 18)
    rng = np.random.default_rng(2)
    text = " ".join(f"w{k}" for k in rng.integers(9999, size=8000))

    def peak(work) -> int:
        tracemalloc.start()
        work()
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    none = cotrain.Model(pd.DataFrame({"view": [], "label": [], "bucket": [], "n": []}).astype(int))
    batches = [pa.RecordBatch.from_pydict({"text": [text] * n, **dict.fromkeys(cotrain.META, ["7"] * n), "label": [k % 2 for k in range(n)]}) for n in (5, 60)]
    for work in (lambda b: list(cotrain.count_batches([b], none, 0.9)), lambda b: none.raw_of(b["text"], [b[c] for c in cotrain.META])):
        one, twelve = (peak(lambda b=b, work=work: work(b)) for b in batches)
        assert twelve < 1.5 * one, (one, twelve)
    raw = none.raw_of(batches[1]["text"], [batches[1][c] for c in cotrain.META])
    assert raw.shape == (60, 2)


# ---- 3 and 6

def test_suffix_dedup_equals_brute_force(spark, sf_dir, pairs):
    assert rows_of(suffix_dedup.op3(spark, sf_dir)) == sorted(suffix_dedup.brute_force(pairs), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("length", [5, 17, 40])
def test_suffix_dedup_short_windows(spark, length, monkeypatch):
    rng = np.random.default_rng(length)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 120))) for _ in range(40)] + [None, "", "aé" * 60, "aé" * 70]
    docs = docs_of(spark, texts)
    out = suffix_dedup.suffix_dedup(docs, length=length).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").alias("n"), F.sha2("kept_bytes", 256).alias("s"))
    assert rows_of(out) == sorted(suffix_dedup.brute_force(list(enumerate(texts)), length), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("shard", [40, 150, 10_000])
@pytest.mark.parametrize("length", [7, 8, 16, 21])
def test_merged_blocks_are_common_prefixes(length, shard):
    rng = np.random.default_rng(shard + length)
    strings = [bytes(rng.integers(97, 99, rng.integers(21, 50)).astype(np.uint8)) for _ in range(12)]
    block = suffix_dedup.merged_blocks(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), length, shard)
    prefixes = [(s[i:] + s * 3)[:length] for s in strings for i in range(len(s))]
    assert len(set(zip(block.tolist(), prefixes, strict=True))) == len(set(prefixes)) == len(set(block.tolist()))


def test_crowded_anchors_compare_by_window(spark, monkeypatch):
    rng = np.random.default_rng(4)
    line = "".join(rng.choice(list("abcdefgh"), 150))
    texts = ["".join(rng.choice(list("xyz"), 30)) + line + "".join(rng.choice(list("xyz"), 30)) for _ in range(60)]
    monkeypatch.setattr(suffix_dedup, "HOT_SLICE", 3)
    want = sorted(suffix_dedup.brute_force(list(enumerate(texts))))
    docs = docs_of(spark, texts)
    out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").alias("n"), F.sha2("kept_bytes", 256).alias("s"))
    assert sorted(map(tuple, out.collect())) == want and sum(r[2] for r in want) > 5000


def test_substring_dedup_equals_brute_force(spark, sf_dir, pairs):
    assert rows_of(substring_dedup.op6(spark, sf_dir)) == sorted(substring_dedup.brute_force(pairs), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_substring_dedup_short_windows(spark, window):
    rng = np.random.default_rng(window)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(50)] + [None, "", " \t", "A a"]
    out = substring_dedup.substring_dedup(docs_of(spark, texts), window=window).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s"))
    assert rows_of(out) == sorted(substring_dedup.brute_force(list(enumerate(texts)), window), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("operator", [suffix_dedup.suffix_dedup, substring_dedup.substring_dedup])
def test_repeat_operators_odd_rows(odd, operator):
    out = operator(odd)
    assert out.count() == odd.count() and set(odd.columns) - {"n_words"} <= set(out.columns)
    assert operator(odd.limit(0)).count() == 0
    assert out.where("doc_id = 4").first()["n_removed"] > 0  # an earlier row has the same words


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def twins(spark):
    """Long words that collide in sums of powers modulo 2**64: Thue-Morse words and their complements."""
    one, tail = thue_morse(1024), " ".join(f"w{i}" for i in range(12))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one} {tail}", f"{other} {tail}", "x" * 300_000 + " " + tail, "x" * 300_001 + " " + tail, "x" * 300_000 + "  " + tail]
    return docs_of(spark, texts), list(enumerate(texts))


def test_words_that_collide_by_structure(twins):
    docs, rows = twins
    out = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("s"))
    assert rows_of(out) == sorted(substring_dedup.brute_force(rows), key=lambda r: tuple(map(str, r)))
    got = minhash.near_duplicates(docs).select("doc_id", *minhash.RESULT)
    assert rows_of(got) == sorted(minhash.brute_force(rows), key=lambda r: tuple(map(str, r)))
    out = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").alias("n"), F.sha2("kept_bytes", 256).alias("s"))
    short = [(i, t) for i, t in rows if i < 2]
    assert {tuple(r) for r in out.where("doc_id < 2").collect()} == set(suffix_dedup.brute_force(short))


def test_digests_tell_ranges_apart():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 2000, 20_000)
    end = start + rng.integers(0, 1200, 20_000)
    a, b = textnp.range_digests(data, start, end)
    parts = [data[i:j].tobytes() for i, j in zip(start, end, strict=True)]
    assert len(set(parts)) == len(set(zip(parts, a.tolist(), b.tolist(), strict=True))) == len(set(a.tolist())) == len(set(b.tolist()))


def test_columns_keep_their_values(spark, odd):
    """Columns that are named like helpers of an operator come back as they were."""
    names = ["__id", "__runs", "__out", "__said", "key", "runs", "out", "said", "id", "row", "fp", "words", "label", "fold"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null and doc_id <> 3")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), F.col("doc_id")) for n in names})
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for out in (exact_dedup.exact_dedup(docs), cotrain.classify_quality(docs, labels, rounds=1), suffix_dedup.suffix_dedup(docs), substring_dedup.substring_dedup(docs), decontam.flag_contaminated(docs, bench), decontam.decontaminate(docs, bench, mode="spans"), minhash.near_duplicates(docs), langid.identify(docs), langid.accepted(docs)):
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[c for c in names if c != "id"], F.lit(1).alias("sha"), F.lit(2).alias("holder"), F.lit("x").alias("payload"))
    assert warc.read_bundles(warc.write_bundles(pages, shared.shared_dir(spark))).count() == pages.count()
    assert packing.pack(docs.withColumn("bin", F.lit(1))).select("doc_id").distinct().count() == docs.count()


def test_scratch_tables_go(spark, documents):
    with shared.scratch(spark) as folder:
        minhash.near_duplicates(documents.limit(5)).count()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert store.exists(path)
    assert not store.exists(path)


# ---- 4

def test_token_counts(spark, documents, pairs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = np.array([len(e.ids) for e in t.encode_batch([x or "" for _, x in pairs], add_special_tokens=False)])
    sums = token_counts.suffix_sums(token_counts.histogram(documents)).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["n_docs"] == (lengths == n).sum() and r["docs_at_least"] == (lengths >= n).sum()
        assert r["tokens_at_least"] == lengths[lengths >= n].sum() and r["truncated_total"] == np.minimum(lengths, n).sum()
    for r in token_counts.at_limits(sums, [0, 100, 2048, 10**9]).collect():
        assert r["docs_over"] == (lengths > r["context_limit"]).sum() and r["truncated_total"] == np.minimum(lengths, r["context_limit"]).sum()
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == np.sort(lengths)[math.ceil(r["share"] * len(lengths)) - 1]


def test_token_counts_odd_rows(odd):
    got = token_counts.histogram(odd).collect()
    assert sum(r["n_docs"] for r in got) == odd.count() and next(r["n_docs"] for r in got if r["n_tokens"] == 0) == 2
    assert token_counts.suffix_sums(token_counts.histogram(odd.limit(0))).count() == 0


# ---- 5

def test_warc_equals_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()
    assert rows_of(warc.op5(spark, sf_dir)) == sorted(warc.brute_force([tuple(r) for r in pages]), key=lambda r: tuple(map(str, r)))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "other"), (6, "u", "ü" * 5000), (6, "u", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, shared.shared_dir(spark), frame_bytes=500, bundle_bytes=900).cache()
    back = {r["page_id"]: r for r in warc.read_bundles(index).collect()}
    assert back[2]["payload"] == b"same" and back[1]["refers_to"] == 2 and back[1]["payload"] is None and back[1]["payload_bytes"] == 4
    assert back[4]["payload"] == b"" and back[3]["refers_to"] == 4 and back[None]["payload"] == b"other" and "\n" not in back[1]["url"]
    got = warc.fetch(index, spark.createDataFrame([(6,), (2,), (77,)], "page_id long")).collect()
    assert sorted(r["page_id"] for r in got) == [2, 6, 6]
    some = warc.write_bundles(pages, shared.shared_dir(spark), min_revisit_bytes=5)
    assert {r["page_id"]: r["record_type"] for r in warc.read_bundles(some).collect()}[1] == "response"
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), shared.shared_dir(spark))).count() == 0


# ---- 7

def test_decontamination_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows_of(decontam.op7(spark, sf_dir)) == sorted(c.sql(decontam.ORACLE).fetchall(), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_cases(spark, limit):
    w = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(10, " ".join(w[:20])), (9, "Short, item!"), (2, None), (3, ""), (4, " ".join(w[:20]))], "item_id long, text string")
    texts = [" ".join(w[:13]), " ".join(w[1:13]), "a SHORT item b", "x y. " + " ".join(w[5:18]).upper() + " z " * 20, None, "", "short items", " ".join(w[:20] + ["q"] * 500)]
    out = decontam.flag_contaminated(docs_of(spark, texts), bench, broadcast_windows=limit)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in out.collect()}
    assert got == {0: (13, 13, 2, True), 1: (12, 0, 0, False), 2: (4, 2, 1, True), 3: (35, 13, 2, True), 4: (0, 0, 0, False), 5: (0, 0, 0, False), 6: (2, 0, 0, False), 7: (520, 20, 2, False)}
    assert {r["items_sha256"] for r in out.where("doc_id = 0").collect()} == {hashlib.sha256(b"10,4").hexdigest()}
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(docs_of(spark, texts), bench, mode="spans").collect()}
    assert cut[2] == "a b" and cut[6] == "short items" and cut[3].startswith("x y. z")
    kept = decontam.decontaminate(docs_of(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7] and kept.columns == docs_of(spark, texts).columns
    with pytest.raises(ValueError):
        decontam.decontaminate(kept, bench, mode="other")


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    out = decontam.flag_contaminated(odd, bench)
    assert out.count() == odd.count() and out.where("n_hit = 3").count() >= 6
    assert decontam.flag_contaminated(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.flag_contaminated(odd.limit(0), bench).count() == 0


# ---- 8

def test_minhash_equals_brute_force(spark, sf_dir, pairs):
    assert rows_of(minhash.op8(spark, sf_dir)) == sorted(minhash.brute_force(pairs), key=lambda r: tuple(map(str, r)))


def crowd():
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(150):
        own = list(base)
        for p in rng.choice(150, rng.integers(0, 5), replace=False):
            own[p] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(own))
    return texts + texts[:5] + [None, "", "one two", "One TWO", "one two three", " ".join(base).upper()]


@pytest.mark.parametrize("how", [{}, {"small": 8, "max_depth": 1}])
def test_minhash_in_crowds(spark, how):
    """One small node, and a node that can't be split and is compared in pairs of blocks: both are exact."""
    got = minhash.near_duplicates(docs_of(spark, crowd()), **how).select("doc_id", *minhash.RESULT)
    assert rows_of(got) == sorted(minhash.brute_force(list(enumerate(crowd()))), key=lambda r: tuple(map(str, r)))


def test_minhash_recall_over_many_branchings(spark):
    """Nodes of 8 in a crowd of 150 branch again and again, which is by chance: nearly all links must be found."""
    got = minhash.near_duplicates(docs_of(spark, crowd()), small=8).select("doc_id", *minhash.RESULT)
    want = minhash.brute_force(list(enumerate(crowd())))
    assert len(set(map(tuple, got.collect())) & set(want)) >= 0.98 * len(want)


def passage_pairs():
    """Pairs at J = 0.85 or a little more that all share a long passage, so that their nodes are large."""
    rng, texts = np.random.default_rng(85), []
    for i in range(250):
        own = [f"p{k}" for k in range(60)] + [f"d{i}x{k}" for k in range(64)]
        texts += [" ".join(own), " ".join(own[: -rng.integers(7, 19)])]  # 120 shingles, 102 to 113 of them: J >= 0.85
    return texts


def test_minhash_finds_links_in_large_nodes(spark):
    """Nodes of more than 4 members branch again; links at the threshold must survive it."""
    texts = passage_pairs()
    got = minhash.near_duplicates(docs_of(spark, texts), small=4).select("doc_id", *minhash.RESULT)
    assert rows_of(got) == sorted(minhash.brute_force(list(enumerate(texts))), key=lambda r: tuple(map(str, r)))


def test_minhash_crowds_do_not_multiply(spark, monkeypatch):
    """Near copies at J of about 0.95: no intermediate table holds more than a fixed number of rows a document."""
    rng, texts = np.random.default_rng(95), []
    for i in range(400):
        own = [f"w{k}" for k in range(200)]
        own[rng.integers(200)] = f"x{i}"
        texts.append(" ".join(own))
    tables, stash = {}, minhash.stash

    def counting(df, folder, name):
        out = stash(df, folder, name)
        tables[folder + name] = out.count()
        assert tables[folder + name] <= 40 * len(texts), (name, tables)
        return out

    monkeypatch.setattr(minhash, "stash", counting)
    got = minhash.near_duplicates(docs_of(spark, texts), small=32).select("doc_id", *minhash.RESULT)
    assert rows_of(got) == sorted(minhash.brute_force(list(enumerate(texts))), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("percent", [80, 85, 95])
@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_minhash_trees_keep_the_recall(percent, depth):
    """Trees played over random agreements of positions: pairs at the threshold part in all of them as seldom as told."""
    rng, t, pairs = np.random.default_rng(percent + depth), percent / 100, 20_000
    agree = rng.random((pairs, minhash.POSITIONS)) < t
    together = np.zeros(pairs, bool)
    for _ in range(minhash.tree_count(0.9999, t, depth)):
        nodes = np.arange(pairs)
        for _ in range(depth):  # each node has 1 or 2 children, each with a position of its own
            child = np.repeat(nodes, 1 + (rng.random(len(nodes)) < 1 / t - 1))
            nodes = child[agree[child, rng.integers(minhash.POSITIONS, size=len(child))]]
        together[nodes] = True
    assert (~together).mean() <= 5e-4


def test_minhash_of_few_rows_takes_few_tasks(spark):
    """Where AQE doesn't combine partitions each shuffle costs a task for each of them: in a small crowd most joins
    broadcast instead."""

    def next_task() -> int:
        return spark.sparkContext.parallelize([0], 1).map(lambda _: TaskContext.get().taskAttemptId()).first()

    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = docs_of(spark, crowd()).coalesce(1)
        began = next_task()
        got = rows_of(minhash.near_duplicates(docs, small=8, max_depth=1).select("doc_id", *minhash.RESULT))
        tasks = next_task() - began
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(minhash.brute_force(list(enumerate(crowd()))), key=lambda r: tuple(map(str, r)))
    assert tasks <= 1250, tasks


def test_minhash_pairs_link_as_sets_do():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(30, size=rng.integers(1, 40)).astype(np.uint64)) for _ in range(400)]
    size, a = np.array([len(x) for x in sets]), np.arange(0, 400, 2)
    want = [i for i in a.tolist() if 100 * len(np.intersect1d(sets[i], sets[i + 1])) >= 60 * len(np.union1d(sets[i], sets[i + 1]))]
    assert want and len(want) < 200
    for entries in (1, 100, 1 << 20):
        assert minhash.linked_pairs(sets, size, a, 60, entries).tolist() == want
    assert minhash.linked_pairs(sets, size, a[:0], 60).tolist() == []


def templates(n: int):
    """Texts of 64 words, 44 of them a template: far from near copies; and every hundredth again with a word changed."""
    rng, texts = np.random.default_rng(n), []
    for i in range(n):
        own = [f"t{k}" for k in range(44)] + [f"d{rng.integers(10**9)}" for _ in range(20)]
        texts.append(" ".join(own))
        if i % 100 == 0:
            texts.append(" ".join([*own[:-1], "other"]))
    return texts


def test_minhash_templates_stay_linear(spark, monkeypatch):
    """Texts that share a template and aren't near copies: rows a document stay below 24 in every step, whatever the
    number of texts, and pairs inside the crowd are found."""
    tables, stash = {}, minhash.stash

    def counting(df, folder, name):
        out = stash(df, folder, name)
        tables[name] = max(tables.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash, "stash", counting)
    for n in (500, 2000):
        tables.clear()
        texts = templates(n)
        got = minhash.near_duplicates(docs_of(spark, texts), small=32).select("doc_id", *minhash.RESULT)
        assert rows_of(got) == sorted(minhash.brute_force(list(enumerate(texts))), key=lambda r: tuple(map(str, r)))
        assert tables["crowd_prefixes"] and max(tables.values()) <= 24 * len(texts), tables
        assert tables["crowd_nodes"] <= len(texts), tables


def test_minhash_odd_rows(odd):
    out = minhash.near_duplicates(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert {r["component_id"] for r in out.where("doc_id in (3, 4, 12)").collect()} == {None}  # the null id is the smallest
    assert out.where("doc_id in (0, 1, 2) and kept").count() == 3
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


# ---- 9

def test_language_id(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.98 and got["score"].between(0, 1).all()
    assert all(h == (crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"], strict=True))


def test_language_id_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = langid.brute_force([tuple(r) for r in docs])
    got = {r["doc_id"]: tuple(r) for r in langid.op9(spark, sf_dir).collect()}
    assert [got[i][:3] for i, *_ in want] == [r[:3] for r in want]
    assert max(abs(got[i][3] - p) for i, _, _, p in want) < 1e-3


def test_language_id_odd_rows(spark, odd):
    out = langid.identify(odd)
    said = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert out.count() == odd.count() and said[0] == said[1] == said[2] == said[11] == "und" and said[3] == "en" and said[7] == "en"
    assert langid.identify(odd.limit(0)).count() == 0
    none = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.accepted(odd).where("doc_id in (0, 1, 2, 11)").count() == 0
    with pytest.raises(ValueError):
        langid.bucket_count(10**5)
    assert langid.bucket_count(4) == langid.BUCKETS and langid.bucket_count(10**4) * 10**4 <= langid.MATRIX_CELLS


def test_accepted_rejects_only_the_unknown(spark):
    """A language that is told with a low score is told."""
    model = (["a", "b", "c"], np.log(np.full(3, 1 / 3)), np.zeros((3, 257), np.float32))
    docs = docs_of(spark, ["some words", "1 2 3", None])
    assert [r["doc_id"] for r in langid.accepted(docs, model=model).collect()] == [0]


# ---- 10

def check_packing(got, texts, size):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*encode(t or ""), 0], dtype="<u4") for i, t in texts}
    for i, own in got.sort_values("piece").groupby("doc_id"):
        start = 0
        for k, r in enumerate(own.itertuples()):
            part = ids[i][r.start : r.start + r.length]
            assert (r.piece, r.start) == (k, start) and crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length
            assert r.length == size or (k == 0 and (len(own) == 1 or r.length < size))
            start += r.length
        assert start == len(ids[i])
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= size


def test_packing(documents, pairs):
    got = packing.pack(documents).toPandas()
    check_packing(got, pairs, 2048)
    assert got["sequence_id"].nunique() <= 1.02 * math.ceil(got["length"].sum() / 2048) + 1


@pytest.mark.parametrize("how", [{"size": 64, "fan_in": 2}, {"size": 64, "fan_in": 2, "carry": 3}])
def test_packing_merges_up_a_tree(documents, pairs, how):
    got = packing.pack(documents.repartition(9), **how).toPandas()
    check_packing(got, pairs, 64)
    assert got["sequence_id"].nunique() <= 1.1 * math.ceil(got["length"].sum() / 64) + 1


@pytest.mark.parametrize("size", [16, 64])
def test_packing_limit_costs_nothing(documents, size):
    """Handing up only as many sequences as there are nodes leaves as few as handing up all."""
    docs = documents.repartition(9)
    few, every = (packing.pack(docs, size=size, fan_in=2, slack=0, carry=n).select("sequence_id").distinct().count() for n in (0, 10**6))
    assert few == every


def test_packing_odd_rows(odd):
    got = packing.pack(odd).toPandas()
    assert len(got[got["doc_id"] == 0]) == 1 and got[got["doc_id"] == 0]["length"].iloc[0] == 1
    assert len(got[got["piece"] == 0]) == odd.count() and packing.pack(odd.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_both_vocabulary_files_agree(text):
    a, b = (packing.encoder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    assert list(a(text)) == list(b(text))


def test_added_tokens_are_tokens(spark):
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "plain"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [list(packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))(x)) for x in texts] == want
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs_of(spark, texts)).collect()}
    assert got == {i: (len(w) + 1, crc32(np.array([*w, 0], dtype="<u4").tobytes())) for i, w in enumerate(want)}
    counts = {r["n_tokens"]: r["n_docs"] for r in token_counts.histogram(docs_of(spark, texts)).collect()}
    assert counts == {n: sum(len(w) == n for w in want) for n in map(len, want)}


def test_packers_see_the_mix_of_lengths(spark):
    """Long documents in one task and short ones in another fill sequences together."""
    texts = [" a" * (39 if i < 200 else 23) for i in range(400)]  # 40 and 24 ids: one of each is a sequence of 64
    got = packing.pack(docs_of(spark, texts).repartitionByRange(2, "doc_id"), size=64, slack=0).toPandas()
    check_packing(got, list(enumerate(texts)), 64)
    assert got["sequence_id"].nunique() <= 230


# ---- pipeline

def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = langid.accepted(docs)
    assert left.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in left.collect()}
    newest: dict[str, int] = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows.items():
        newest[t.translate(lower)] = max(i, newest.get(t.translate(lower), i))
    rows = {i: t for i, t in rows.items() if newest[t.translate(lower)] == i}
    rows = {i: rows[i] for i, _, _, kept in minhash.brute_force(list(rows.items()), percent=80) if kept}
    flags = {r["doc_id"]: r["contaminated"] for r in decontam.op7(spark, sf_dir).collect()}
    rows = {i: t for i, t in rows.items() if not flags[i]}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got["doc_id"]) == set(rows)
    check_packing(got, list(rows.items()), 2048)


def test_pipeline_of_odd_rows(spark, odd, sf_dir):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_registered():
    assert len([n for n in queries.QUERIES if n.startswith("op")]) == 10 and "pipeline" in queries.QUERIES
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op3_suffix_dedup", "op5_warc", "op6_substring_dedup", "op8_minhash_dedup"])
def test_query_equals_its_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for table in ("documents", "pages"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == sorted(c.sql(queries.ORACLE_SQL[name]).fetchall(), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("piece", [" ", "\n", "x", "7", "😀", " \n"])
def test_encoder_of_very_long_runs(piece):
    """Two million characters of a kind in a row, with words around them, against an untouched tokenizer."""
    from tokenizers import Tokenizer

    text = "It is " + piece * (2_000_000 // len(piece)) + "the end"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))(text) == want
