"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are the leaves of a tree for each source, in the order of their ids; the subroots of the sources, in the order of
the sources, are the leaves of one more tree.  `fan` consecutive nodes become their hash until one is left.

Proofs: every node holds the segment of siblings on its way to an ancestor, at first its parent.  A round joins the
nodes with themselves: the segment of the ancestor is put behind one's own, which doubles the distance, until every
leaf has reached the root - five rounds for a tree of 10**13 leaves.  Only nodes that are high enough to be an
ancestor at the present distance are looked up, a fan**distance-th of all, so that soon they are few enough to be
broadcast and leaves stay where they are.  No key has more than fan**distance rows below it before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.numbering import numbered
from lumenfold.llm.shared import forget, shared_dir, stash

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of nodes with their segments that may be broadcast.
NODE_BYTES = 24 << 20
#: Tree of the subroots; those of the sources are 0, 1, 2 ...
TOP = -1


def field(c: Column) -> Column:
    """A value as part of a leaf: its length in bytes, a colon and itself; null is a dash."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def joined(digests: Column) -> Column:
    """Hex text of an array of binary digests, one behind the other."""
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def folded(leaf: Column, segments: Column) -> Column:
    """The node that a leaf (hex) and the siblings along its way lead to (hex)."""
    return F.aggregate(segments, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["left"])), h, F.lower(F.hex(s["right"]))), 256))


def proof_digest(segments: Column) -> Column:
    """Hash of all siblings on the way, from left to right, level by level."""
    return F.sha2(joined(F.transform(segments, lambda s: F.concat(s["left"], s["right"]))), 256)


def grow(nodes: DataFrame, fan: int, folder: str, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of trees, as runs (tree, run, n, kids, digest), and (tree, digest) of what remains of each.  nodes are
    (tree, idx, n, digest, doc): n counts the nodes of the tree on this level."""
    levels, roots = [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", "doc"))) if not levels else F.array_sort(F.collect_list(F.struct("idx", "digest")))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {fan}").alias("run")).agg(F.max("n").alias("n"), kids.alias("kids"))
        runs = runs.withColumn("digest", F.unhex(F.sha2(joined(F.transform("kids", lambda k: k["digest"])), 256)))
        runs = stash(runs, folder, f"{name}{len(levels)}")
        if runs.isEmpty():
            break
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), "digest")
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return levels, stash(out, folder, f"{name}_roots")


def key(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def nodes_of(levels: list[DataFrame], fan: int, top: bool) -> list[DataFrame]:
    """(node, up, segments, doc): each node below a root with its parent and the siblings in its run; doc is null but
    for leaves of sources.  A subroot goes by its name in the tree of subroots."""
    out = []
    for level, runs in enumerate(levels):
        doc = F.col("kid.doc") if level == 0 and not top else F.lit(None).cast(levels[0].schema["kids"].dataType.elementType["doc"].dataType)
        each = runs.select("tree", "run", "n", "kids", F.posexplode("kids").alias("pos", "kid"))
        digests = F.transform("kids", lambda k: k["digest"])
        nothing = F.unhex(F.lit(""))
        side = lambda d: F.aggregate(d, nothing, lambda a, x: F.concat(a, x))
        left, right = side(F.slice(digests, 1, F.col("pos"))), side(F.slice(digests, F.col("pos") + 2, fan))
        parent = key(F.col("tree"), F.lit(level + 1), F.col("run"))
        if not top:
            parent = F.when(F.col("n") <= fan, key(F.lit(TOP), F.lit(0), F.col("tree"))).otherwise(parent)
        segment = F.struct(left.alias("left"), right.alias("right"), F.lit(top).alias("top"))
        out.append(each.select(key(F.col("tree"), F.lit(level), F.col("kid.idx")).alias("node"), parent.alias("up"), F.array(segment).alias("segments"), doc.alias("doc")))
    return out


def jump(nodes: DataFrame, folder: str) -> DataFrame:
    """(doc, segments) of every leaf, with all siblings up to the root: rounds that double the distance."""
    spark, k = nodes.sparkSession, 0
    nodes = stash(nodes, folder, "paths0")
    while not nodes.where("up is not null").isEmpty():
        reach = 1 << k
        above = lambda least: (F.col("node.tree") == TOP) | (F.col("node.level") >= least)
        ancestors = nodes.where(F.col("doc").isNull() & above(reach)).select(F.col("node").alias("at"), F.col("up").alias("higher"), F.col("segments").alias("more"))
        size = ancestors.count() * (120 + 130 * reach)
        moving = nodes.where(F.col("doc").isNotNull() | above(2 * reach))
        walked = moving.where("up is not null").join(F.broadcast(ancestors) if size <= NODE_BYTES else ancestors, F.col("up") == F.col("at"), "left")
        # where nobody stands above, the ancestor is the root
        walked = walked.select("node", F.col("higher").alias("up"), F.when(F.col("at").isNull(), F.col("segments")).otherwise(F.concat("segments", "more")).alias("segments"), "doc")
        k += 1
        nodes = stash(walked.unionByName(moving.where("up is null").select("node", "up", "segments", "doc")), folder, f"paths{k}")
        forget(spark, f"{folder}/paths{k - 1}")
    return nodes.where(F.col("doc").isNotNull()).select("doc", "segments")


def proofs(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", fan: int = 3, extra: dict[str, Column] | None = None) -> tuple[DataFrame, str | None]:
    """(id, leaf, subroot, segments and the columns of `extra`) for each row of docs, and the root (None without rows).

    A segment is a struct of the siblings left and right of the way (binary digests, one behind the other) and whether
    it lies above the subroots.  folded(leaf, segments) is the root, and proof_digest(segments) sums a proof up.

    Nulls are written as a dash in leaves; ids that are null come first, as does the source null.  Rows of equal id
    are ordered by their leaves, and rows that are repeated are leaves next to each other.  Empty and very long
    texts are hashed whole.  Only `columns` are read, so others may have any name.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    source = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.unhex(leaf_digest(*[F.col(f"`{c}`") for c in columns])).alias("digest"), F.struct(*[v.alias(n) for n, v in (extra or {}).items()], F.lit(True).alias("leaf")).alias("extra"))
    rows = stash(rows.withColumn("tie", F.monotonically_increasing_id()), folder, "leaves")
    placed, runs = numbered(rows, ["source"], [F.col("id").asc_nulls_first(), F.col("digest"), F.col("tie")], folder, "laid")
    sources = stash(runs.groupBy("source").agg(F.max("total").alias("n")), folder, "sources")
    ranked, _ = numbered(sources, [], [F.col("source").asc_nulls_first()], folder, "ranked")
    ranked = stash(ranked.select(F.col("source").alias("of"), F.col("before").alias("tree"), F.octet_length("source").alias("size")), folder, "trees")
    many, text = ranked.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    trees = ranked.select("of", "tree")
    trees = F.broadcast(trees) if 64 * many + text <= NODE_BYTES else trees
    doc = F.struct("id", "digest", "extra").alias("doc")
    leaves = placed.join(trees, F.col("source").eqNullSafe(F.col("of"))).select("tree", F.col("before").alias("idx"), F.col("total").alias("n"), "digest", doc)
    leaves = stash(leaves, folder, "placed")
    forget(spark, f"{folder}/leaves", f"{folder}/laid")
    levels, subroots = grow(leaves, fan, folder, "level")
    tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), "digest", F.lit(None).cast(leaves.schema["doc"].dataType).alias("doc"))
    upper, roots = grow(tops, fan, folder, "top")
    first = roots.first()  # a row, if there is any
    root = first["digest"].hex() if first else None
    alone = leaves.where("n = 1").select(
        key(F.col("tree"), F.lit(0), F.col("idx")).alias("node"), (key(F.lit(TOP), F.lit(0), F.col("tree")) if many > 1 else F.lit(None).cast("struct<tree:long,level:int,idx:long>")).alias("up"),
        F.array().cast("array<struct<left:binary,right:binary,top:boolean>>").alias("segments"), "doc",
    )
    paths = alone
    for part in (*nodes_of(levels, fan, False), *nodes_of(upper, fan, True)):
        paths = paths.unionByName(part)
    found = jump(paths, folder)
    leaf = F.lower(F.hex("doc.digest"))
    own = folded(leaf, F.filter("segments", lambda s: ~s["top"]))
    return found.select(F.col("doc.id").alias("id"), leaf.alias("leaf"), own.alias("subroot"), "segments", *[F.col(f"doc.extra.{n}") for n in extra or {}]), root


def op11(spark, sf_dir: str) -> DataFrame:
    """op11_merkle_manifest: one row per document, every second one (by crc32 of its id) tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_digest(*[F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    rows, root = proofs(docs, extra={"tampered": F.when(hit, F.unhex(changed))})
    again = folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("segments"))
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("segments")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a decimal id, by bits: 3988292384 is the reversed polynomial.
CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda r, b:
 list_reduce(list_prepend(xor(r, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))"""

_FIELDS = "||".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)
ORACLE = f"""
WITH RECURSIVE base AS (SELECT doc_id, source, sha256({_FIELDS}) AS leaf,
  CASE WHEN xor({CRC.format(text="doc_id::VARCHAR")}, 4294967295) % 2 = 0 THEN sha256({_FIELDS.replace("text::VARCHAR", "replace(text, chr(10), '')")}) END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base),
tree AS (
  SELECT 0 AS level, source, idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT level + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY level, source, idx // 3),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n FROM tree WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3),
sub AS (SELECT source, digest AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM tree WHERE n = 1),
nodes AS (SELECT tree.source, sub.rank, level, idx, digest, n FROM tree JOIN sub ON tree.source IS NOT DISTINCT FROM sub.source),
walk AS (
  SELECT l.doc_id, l.leaf, l.tampered, l.idx, s.rank, s.subroot, g.level, false AS top, (l.idx // (3 ** g.level)::BIGINT)::BIGINT AS own
  FROM leaves l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source, range(0, 60) g(level) WHERE g.level < s.height
  UNION ALL
  SELECT l.doc_id, l.leaf, l.tampered, l.idx, s.rank, s.subroot, g.level, true, (s.rank // (3 ** g.level)::BIGINT)::BIGINT
  FROM leaves l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source, range(0, 60) g(level) WHERE g.level < (SELECT max(level) FROM tops)),
beside AS (
  SELECT w.doc_id, w.idx, w.rank, w.top, w.level, x.idx < w.own AS ahead, x.idx AS place, x.digest FROM walk w JOIN nodes x ON NOT w.top AND x.rank = w.rank AND x.level = w.level AND x.idx // 3 = w.own // 3 AND x.idx <> w.own
  UNION ALL
  SELECT w.doc_id, w.idx, w.rank, w.top, w.level, x.idx < w.own, x.idx, x.digest FROM walk w JOIN tops x ON w.top AND x.level = w.level AND x.idx // 3 = w.own // 3 AND x.idx <> w.own),
steps AS (
  SELECT w.rank, w.idx, row_number() OVER (PARTITION BY w.rank, w.idx ORDER BY w.top, w.level) AS step, coalesce(b.l, '') AS l, coalesce(b.r, '') AS r
  FROM walk w LEFT JOIN (SELECT rank, idx, top, level, string_agg(digest, '' ORDER BY place) FILTER (WHERE ahead) AS l, string_agg(digest, '' ORDER BY place) FILTER (WHERE NOT ahead) AS r FROM beside GROUP BY ALL) b
  ON w.rank = b.rank AND w.idx = b.idx AND w.top = b.top AND w.level = b.level),
ways AS (SELECT rank, idx, sha256(string_agg(l || r, '' ORDER BY step)) AS proof, list({{'l': l, 'r': r}} ORDER BY step) AS way FROM steps GROUP BY ALL),
fold AS (
  SELECT l.doc_id, l.leaf, s.subroot, coalesce(p.proof, sha256('')) AS proof, coalesce(p.way, []) AS way, 0 AS k, coalesce(l.tampered, l.leaf) AS h
  FROM leaves l JOIN sub s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN ways p ON p.rank = s.rank AND p.idx = l.idx
  UNION ALL
  SELECT doc_id, leaf, subroot, proof, way, k + 1, sha256(way[k + 1].l || h || way[k + 1].r) FROM fold WHERE k < len(way))
SELECT doc_id, leaf, subroot, t.digest AS root, proof AS proof_sha256, h AS folded_root, h = t.digest AS verified FROM fold, (SELECT digest FROM tops WHERE n = 1) t WHERE k = len(way)
"""
