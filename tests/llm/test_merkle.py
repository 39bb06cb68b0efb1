"""The Merkle manifest against a sequential version."""

import hashlib
from zlib import crc32

import duckdb
import pytest

from lumenfold.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    put = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(put(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(nodes, fan):
    """The root of nodes, and for each the siblings (left, right) on its way."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(ways):
            run = nodes[at[i] // fan * fan :][:fan]
            way.append(("".join(run[: at[i] % fan]), "".join(run[at[i] % fan + 1 :])))
            at[i] //= fan
        nodes = [h("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
    return nodes[0], ways


def sequential(rows, fan=3):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in order:
        ordered = sorted(trees[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        grown[s] = ordered, *climb([leaf(r, r["text"]) for r in ordered], fan)
    root, upper = climb([grown[s][1] for s in order], fan)
    out = []
    for s, above in zip(order, upper, strict=True):
        ordered, subroot, ways = grown[s]
        for r, way in zip(ordered, ways, strict=True):
            full = way + above
            hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            fold = leaf(r, r["text"].replace("\n", "") if hit else r["text"])
            for left, right in full:
                fold = h(left + fold + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, h("".join(a + b for a, b in full)), fold, fold == root))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def run(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11(spark, str(tmp_path)).collect()), key=lambda r: tuple(map(str, r)))


def test_merkle_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(c.sql(merkle.ORACLE).fetchall(), key=lambda r: tuple(map(str, r)))
    df = merkle.op11(spark, sf_dir)
    assert df.columns == [d[0] for d in c.sql(merkle.ORACLE).description]
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r))) == want


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_merkle_odd_rows(spark, tmp_path, monkeypatch, limit):
    """Nulls, ties, repeated rows, empty and very long texts, a source with most rows, sources of one row, columns with
    clashing names; with broadcast nodes and without."""
    monkeypatch.setattr(merkle, "NODE_BYTES", limit)
    rows = [(i, f"text {i}\nmore" if i % 3 else f"text {i}", "en", "hot" if i % 3 else f"s{i}", i) for i in range(60)]
    rows += [(None, None, None, None, None), (None, "a\nb", None, "hot", 1), (7, "tie\n", "en", "hot", 1), (7, "", "en", "hot", 1), (1, "text 1\nmore", "en", "hot", 1), (90, "z\n" * 500_000, "é", "", 2), (91, "日本\n語", "en", "é", 3)]
    df = spark.createDataFrame([(*r, 1, 2, "x", True) for r in rows], DOCS + ", tree long, idx long, node string, leaf boolean")
    got = run(spark, df, tmp_path)
    assert got == sequential([r.asDict() for r in df.collect()])
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_merkle_small_tables(spark, tmp_path):
    one = spark.createDataFrame([(4, "x\ny", "en", "s", 3)], DOCS)
    assert run(spark, one, tmp_path) == sequential([one.first().asDict()])
    assert run(spark, one.limit(0), tmp_path) == []
    assert merkle.proofs(one.limit(0))[1] is None


@pytest.mark.parametrize("fan", [2, 5])
def test_merkle_other_fans(spark, fan):
    df = spark.createDataFrame([(i, str(i), "en", f"s{i % 4}", 1) for i in range(40)], DOCS)
    rows, root = merkle.proofs(df, fan=fan)
    want = {r[0]: r for r in sequential([r.asDict() for r in df.collect()], fan)}
    got = rows.select("id", "leaf", "subroot", merkle.proof_digest(rows["segments"]).alias("p"), merkle.folded(rows["leaf"], rows["segments"]).alias("f")).collect()
    assert len(got) == 40 and all((r["leaf"], r["subroot"], root, r["p"], r["f"]) == (*want[r["id"]][1:5], root) for r in got)
