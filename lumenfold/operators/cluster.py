"""Greedy leader clustering of a similarity graph, as an iterated DataFrame job.

In order of ids, a node that no earlier leader is similar to becomes a leader; others join their earliest leader.  The
leaders are the lexicographically first maximal independent set, so rounds decide many nodes at once: an undecided
node without undecided earlier neighbours leads, and its neighbours are members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.tables import forget, working_folder, written

#: Rounds by joins alone before ranges of ids are replayed, and the edges of a range.
ROUNDS, RANGE = 8, 500_000
#: Rows that the driver may settle at the end of leaders_of_classes().
REST = 200_000


def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The leaders among a range of ids, by the sequential rule: rows are (id, i), an open edge to an earlier node or,
    with a null i, the node itself.  Nodes whose earlier neighbours aren't all known stay open unless one leads."""
    rows = pd.concat([*batches, pd.DataFrame({"id": [], "i": []})]).sort_values("id")
    own = rows["i"].isna()
    known = dict.fromkeys(rows.loc[own, "id"].astype(np.int64).tolist())  # None while open
    edges = rows[~own].astype(np.int64)
    ends = {}
    for j, i in zip(edges["id"].tolist(), edges["i"].tolist(), strict=True):
        ends.setdefault(j, []).append(i)
    for j in known:
        states = [known.get(i) for i in ends.get(j, ())]
        known[j] = False if True in states else None if None in states else True
    yield pd.DataFrame({"id": np.array([j for j, leads in known.items() if leads], np.int64)})


def leaders_in_ranges(undecided: DataFrame, open_edges: DataFrame, n_edges: int) -> DataFrame:
    """(id): leaders that follow within ranges of ids, each replayed by one task.  A node with more earlier neighbours
    than a range has edges waits until they are decided."""
    hot = open_edges.groupBy("j").agg(F.count("*").alias("n")).where(F.col("n") > RANGE).select("j")
    edges = open_edges.join(hot, "j", "left_anti").select(F.col("j").alias("id"), "i")
    nodes = undecided.join(hot.withColumnRenamed("j", "id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("i"))
    ranges = max(1, -(-n_edges // RANGE))
    return nodes.union(edges).repartitionByRange(ranges, "id").mapInPandas(replayed, undecided.schema)


def leaders(edges: DataFrame, *, rounds: list[int] | None = None) -> DataFrame:
    """(leader, member) for every member; edges are (i, j) with i < j.  Nodes without edges lead nobody.

    A round decides the nodes without open earlier neighbours and those beside them, until all are decided.  Where ids
    rise along a chain that is few nodes a round, so after ROUNDS rounds ranges of ids are replayed in order, all at the
    same time: what a range can tell is decided at once, and a chain takes a round for each of its ranges.
    Tables of the shared folder cut the lineage, so a lost executor costs one round at most.  The number of rounds is
    added to `rounds`.
    """
    folder = working_folder(edges.sparkSession)
    edges = written(edges.where("i < j").select("i", "j").distinct(), f"{folder}/edges")
    undecided = written(edges.select(F.col("i").alias("id")).union(edges.select("j")).distinct(), f"{folder}/undecided0")
    open_edges, k = edges, 0
    while not undecided.isEmpty():
        k += 1
        if k > ROUNDS:
            new = written(leaders_in_ranges(undecided, open_edges, open_edges.count()), f"{folder}/leaders{k}")
        else:
            new = written(undecided.join(open_edges.select(F.col("j").alias("id")).distinct(), "id", "left_anti"), f"{folder}/leaders{k}")
        gone = new.union(open_edges.join(new.withColumnRenamed("id", "i"), "i", "left_semi").select(F.col("j").alias("id"))).distinct()
        gone = written(gone, f"{folder}/gone{k}")
        undecided = written(undecided.join(gone, "id", "left_anti"), f"{folder}/undecided{k}")
        left = open_edges.join(gone.withColumnRenamed("id", "i"), "i", "left_anti").join(gone.withColumnRenamed("id", "j"), "j", "left_anti")
        open_edges = written(left.select("i", "j"), f"{folder}/edges{k}")
    if rounds is not None:
        rounds.append(k)
    if k == 0:
        return edges.select(F.col("i").alias("leader"), F.col("j").alias("member"))
    chosen = edges.sparkSession.read.schema(undecided.schema).parquet(*[f"{folder}/leaders{n}" for n in range(1, k + 1)])
    of_leaders = edges.join(chosen.withColumnRenamed("id", "i"), "i", "left_semi")
    # a leader has no earlier leader beside it, so only members are reached
    found = written(of_leaders.groupBy("j").agg(F.min("i").alias("leader")).select("leader", F.col("j").alias("member")), f"{folder}/found")
    done = [f"{folder}/{name}{n}" for name in ("leaders", "gone", "undecided", "edges") for n in range(k + 1)]
    forget(edges.sparkSession, f"{folder}/edges", *done)
    return found


def rest_leaders_of_classes(nodes: list[tuple[int, str]], links: list[tuple[str, str]]) -> list[int]:
    """The leaders among (id, class) nodes by the sequential rule; links are symmetric and hold every class itself."""
    beside: dict[str, list[str]] = {}
    for c, d in links:
        beside.setdefault(c, []).append(d)
    owned: dict[int, list[str]] = {}
    for i, c in nodes:
        owned.setdefault(i, []).append(c)
    covered: set[str] = set()
    out = []
    for i in sorted(owned):
        if not covered.intersection(owned[i]):
            out.append(i)
            covered.update(d for c in owned[i] for d in beside[c])
    return out


def leaders_of_classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(leader, member) where nodes are similar through classes: nodes are (id, c), an id in one class or several; two
    ids are similar if a class of one is linked with a class of the other or is the same; links are (c, d) of different
    classes, in one direction.

    The rule is that of leaders(), but ids of a class are never paired: a class passes on the least id that it holds,
    so a class with a third of all ids costs one row a link.
    """
    spark, folder = nodes.sparkSession, working_folder(nodes.sparkSession)
    nodes = written(nodes.select("id", "c").distinct(), f"{folder}/nodes")
    both = F.explode(F.array(F.struct("c", "d"), F.struct(F.col("d").alias("c"), F.col("c").alias("d"))))
    links = links.select(both.alias("l")).select("l.*").union(nodes.select("c", F.col("c").alias("d"))).distinct()
    links = written(links, f"{folder}/links")

    def least_beside(rows: DataFrame) -> DataFrame:
        """(id, least) for all nodes that have an id of rows (id, c) beside them or are one: the least such id."""
        of_class = rows.groupBy(F.col("c").alias("d")).agg(F.min("id").alias("m"))
        near = links.join(of_class, "d").groupBy("c").agg(F.min("m").alias("m"))
        return nodes.join(near, "c").groupBy("id").agg(F.min("m").alias("least"))

    undecided, k = nodes, 0
    while not undecided.isEmpty():
        k += 1
        inner = undecided.select("c").distinct()
        rest = links.join(inner, "c", "left_semi")
        if k > ROUNDS and undecided.count() + rest.count() <= REST:
            settled = rest_leaders_of_classes([tuple(r) for r in undecided.collect()], [tuple(r) for r in rest.collect()])
            written(spark.createDataFrame([(i,) for i in settled], "id long"), f"{folder}/leaders{k}")
            break
        first = undecided.select("id").distinct().join(least_beside(undecided), "id").where("id = least").select("id")
        first = written(first, f"{folder}/leaders{k}")
        gone = least_beside(nodes.join(first, "id", "left_semi")).select("id")
        undecided = written(undecided.join(gone, "id", "left_anti"), f"{folder}/undecided{k}")
    if k == 0:
        return nodes.select(F.col("id").alias("leader"), F.col("id").alias("member")).limit(0)
    chosen = spark.read.schema("id long").parquet(*[f"{folder}/leaders{n}" for n in range(1, k + 1)])
    found = least_beside(nodes.join(chosen, "id", "left_semi")).where("least <> id").select(F.col("least").alias("leader"), F.col("id").alias("member"))
    found = written(found, f"{folder}/found")
    forget(spark, *[f"{folder}/{name}" for name in ("nodes", "links")], *[f"{folder}/{name}{n}" for name in ("leaders", "undecided") for n in range(1, k + 1)])
    return found


def with_leaders(nodes: DataFrame, groups: DataFrame, *, id_col: str = "id") -> DataFrame:
    """nodes plus their leader: themselves where they are members of nothing."""
    found = groups.select(F.col("member").alias(id_col), "leader")
    return nodes.join(found, id_col, "left").withColumn("leader", F.coalesce("leader", F.col(id_col)))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(leader, size) of groups of two and more."""
    return groups.groupBy("leader").agg((F.count("*") + 1).alias("size"))
