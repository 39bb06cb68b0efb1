"""Repair of the structure of conversations: faults, and the cheapest edits to turns that alternate.

Roles must read (s?(ua)+)?: nothing, or a system turn or none and then user and assistant in turn.  Which turns to
keep, rename, delete or insert is a shortest path through four states, found by a rank-convergent parallel Viterbi:

1. Rows are numbered within their conversation; `chunk` consecutive ones are the unit of work.  Rows that have to be
   deleted leave every state as it is, so they take no part.
2. Costs run backwards.  What stands behind a chunk isn't known yet, so a chunk starts from four speculative cost
   vectors, each of which favours one state.  If the vectors at its other end differ only by constants, what stands
   behind doesn't matter: the chunk's costs are known.
3. Fix-up passes settle the others: a chunk looks at the one behind it and takes over its costs, or, where those are
   open too, leaps over it, so that the distance doubles and passes grow with the logarithm of the chunks.
4. The stitched costs make each chunk's cheapest edits known from every state it may start in, and with them the state
   it ends in; by the same passes, in the other direction, the chunks' first states follow.
5. Each chunk traces its edits: of equally cheap ones those whose initials (Delete, Insert, Keep, Rerole) come first.

Conversations of one chunk - nearly all - need step 5 only.  Chunks, never whole conversations, are held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.merkle import CRC
from lumenfold.llm.numbering import numbered
from lumenfold.llm.shared import forget, shared_dir, small_side, stash

#: Rows of a conversation that are worked on at once.
CHUNK = 10_000
#: States: 0 nothing yet, 1 behind a system turn, 2 behind a user turn, 3 behind an assistant turn.  0 and 3 may end.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state behind an inserted or renamed turn, and its role.
STEP, ADDED = (2, 2, 3, 2), ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Costs behind a conversation's last row, by state: turns to insert until it may end.
END = (0, 6, 3, 0)
#: More than costs of two states can differ by: what a speculative vector has for the states it doesn't favour.
FAR = 64
BASIS = tuple(tuple(0 if s == t else FAR for s in range(4)) for t in range(4))
LEGAL = {"su", "ua", "au"}
SPACES, LOUD = r"^[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"


@cache
def before_row(costs: tuple, symbol: str) -> tuple[tuple, int]:
    """Costs in front of a row (less their minimum, and that) from those behind it.  symbol: the initial of its role,
    and t if it is truncated."""
    cut = CUT_OFF if symbol[1:] == "t" else 0
    raw = [min(DELETE + costs[s], RENAME + cut + costs[STEP[s]], cut + costs[KEEP[s, symbol[0]]] if (s, symbol[0]) in KEEP else 1 << 60) for s in range(4)]
    all_ = [min(raw[s], INSERT + raw[STEP[s]], 2 * INSERT + raw[STEP[STEP[s]]]) for s in range(4)]
    low = min(all_)
    return tuple(c - low for c in all_), low


def speculate(symbols: list[str]) -> list[int]:
    """Costs in front of a chunk for each of the four speculative vectors behind it, 16 numbers."""
    out = []
    for costs in BASIS:
        total = 0
        for symbol in reversed(symbols):
            if symbol:
                costs, low = before_row(costs, symbol)
                total += low
        out += [total + c for c in costs]
    least = min(out)
    return [c - least for c in out]


def trace(symbols: list[str], copies: list[int], behind: tuple, state: int, last: bool) -> tuple[int, int, list[tuple[str, str, str]]]:
    """(last state, cost, edits) of the cheapest edits of a chunk from a state on; edits are (inserted roles, letter,
    new role or "") by row.  Of `copies` equal rows all but the first are deleted."""
    after = [behind]
    for symbol in reversed(symbols):
        after.append(before_row(after[-1], symbol)[0] if symbol else after[-1])
    after.reverse()
    cost, edits = 0, []
    for i, (symbol, n) in enumerate(zip(symbols, copies, strict=True)):
        added, role = "", ""
        if not symbol:
            letter = "D"
        else:
            here, (front, low) = after[i + 1], before_row(after[i + 1], symbol)
            cut = CUT_OFF if symbol[1:] == "t" else 0
            while True:
                now = front[state] + low
                if DELETE + here[state] == now:
                    letter = "D"
                    break
                if INSERT + front[STEP[state]] + low == now:
                    added, cost, state = added + ADDED[state], cost + INSERT, STEP[state]
                    continue
                to = KEEP.get((state, symbol[0]))
                if to is not None and cut + here[to] == now:
                    letter, role, cost, state = "K", "k", cost + cut, to
                    break
                letter, role, cost, state = "R", ADDED[state], cost + RENAME + cut, STEP[state]
                break
        cost += DELETE * (n - 1) + (DELETE if letter == "D" else 0)
        edits.append((added, letter, role))
    if last:
        added = ""
        while END[state]:
            added, cost, state = added + ADDED[state], cost + INSERT, STEP[state]
        edits.append((added, "", ""))
    return state, cost, edits


# ---- rows

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of conversations (conv_id, turn, role, text) after damage that follows from crc32 of
    `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's."""
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", put("role").alias("role"), put("text").alias("text"), (F.crc32(F.concat(put("conv_id"), F.lit(":"), put("turn")).cast("binary")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(rows: DataFrame, folder: str, chunk: int) -> DataFrame:
    """(conv, turn, role, digest, n, blank, first, truncated, before, total, chunk): rows that are equal in all are one,
    n is how many; `first` is whether no earlier one has the same role and text.  No text in it."""
    text = F.col("text")
    seen = with_digest(rows).withColumns({"blank": text.rlike(SPACES), "truncated": ~text.rlike(LOUD)})
    seen = stash(seen.groupBy("conv", "turn", "role", "digest").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), folder, "classes")
    placed, _ = numbered(seen, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], folder, "turns")
    placed = stash(placed, folder, "placed")
    # by its number, as a text that a third of all rows share has one first row in a conversation
    firsts = placed.groupBy("conv", "role", "digest").agg(F.min("before").alias("least")).select(F.col("conv").alias("of"), "least")
    found = placed.join(firsts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("before") == F.col("least")), "left")
    out = stash(found.select(*placed.columns, F.col("least").isNotNull().alias("first"), F.expr(f"before div {chunk}").alias("chunk")), folder, "faults")
    forget(rows.sparkSession, f"{folder}/classes", f"{folder}/turns", f"{folder}/placed")
    return out


def symbol_of(r: dict) -> str:
    """What the search sees of a row: "" for one that has to go."""
    return "" if r["blank"] or not r["first"] else (r["role"][:1] or "?") + ("t" if r["truncated"] else "")


def by_chunk(df: DataFrame, work: Callable[[tuple, list[dict]], dict], schema: str) -> DataFrame:
    """work((conv, chunk), rows in order) for every chunk; tasks hold one chunk and one batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out, size = (r for b in batches for r in b.to_pylist()), [], 0
        for key, group in groupby(rows, key=lambda r: (r["conv"], r["chunk"])):
            held = list(group)
            out.append({"conv": key[0], "chunk": key[1], **work(key, held)})
            size += len(held)
            if size >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "before").mapInArrow(run, schema)


# ---- stitching

def apply_costs(own: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Costs in front of a chunk (from speculate()) when `value` is what stands behind it."""
    costs = (own.reshape(4, 4) + value[:, None]).min(axis=0)
    return costs - costs.min()


def compose_costs(own: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """The same for two chunks together: each speculative vector passes the hind one first."""
    costs = (behind.reshape(4, 4)[:, :, None] + own.reshape(1, 4, 4)).min(axis=1)
    return (costs - costs.min()).ravel()


def apply_states(own: np.ndarray, value: np.ndarray) -> np.ndarray:
    return own[value]


def resolved(links: DataFrame, apply: Callable, compose: Callable, folder: str, name: str) -> DataFrame:
    """(conv, chunk, value) where `links` (conv, chunk, toward, value, map) gives value = apply(map, value of toward) for
    those that have none yet.  Each pass looks one link further, and twice as far where that is open, too."""
    spark, k, schema = links.sparkSession, 0, links.schema
    links = stash(links, folder, f"{name}0")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, chunk, own, toward, value, far in zip(pdf["conv"], pdf["chunk"], pdf["map"], pdf["ahead"], pdf["known"], pdf["far"], strict=True):
                own = np.asarray(own)
                if value is not None:
                    out.append((conv, chunk, chunk, apply(own, np.asarray(value)), own))
                else:
                    out.append((conv, chunk, toward, None, compose(own, np.asarray(far))))
            yield pd.DataFrame(out, columns=["conv", "chunk", "toward", "value", "map"])

    while not links.where("value is null").isEmpty():
        k += 1
        other = links.select(F.col("conv").alias("of"), F.col("chunk").alias("at"), F.col("toward").alias("ahead"), F.col("value").alias("known"), F.col("map").alias("far"))
        moved = links.where("value is null").join(other, F.col("conv").eqNullSafe(F.col("of")) & (F.col("toward") == F.col("at"))).mapInPandas(step, schema)
        links = stash(links.where("value is not null").unionByName(moved), folder, f"{name}{k}")
    return links.select("conv", "chunk", "value")


def settled(rows: DataFrame, folder: str, chunk: int) -> DataFrame | None:
    """(conv, chunk, behind, state) for conversations of several chunks: costs behind each chunk, and its first state."""
    long = rows.where(F.col("total") > chunk)
    if long.isEmpty():
        return None
    kind = rows.schema["conv"].dataType.simpleString()
    whole = f"conv {kind}, chunk long, toward long, value array<long>, map array<long>"

    def costs(key: tuple, group: list[dict]) -> dict:
        own, last = speculate([symbol_of(r) for r in group]), group[-1]["before"] + 1 == group[-1]["total"]
        vectors = np.asarray(own).reshape(4, 4)
        alone = vectors - vectors.min(axis=1, keepdims=True)
        value = apply_costs(np.asarray(own), np.asarray(END)).tolist() if last else alone[0].tolist() if (alone == alone[0]).all() else None
        return {"toward": key[1] + 1, "value": value, "map": own}

    fronts = resolved(by_chunk(long, costs, whole), apply_costs, compose_costs, folder, "costs")
    behind = fronts.select(F.col("conv").alias("of"), (F.col("chunk") - 1).alias("at"), F.col("value").alias("behind"))
    behind = stash(behind.where("at >= 0"), folder, "behind")

    def states(key: tuple, group: list[dict]) -> dict:
        """From the chunk's first state to that of the next one, whose link this is."""
        symbols, copies, after = [symbol_of(r) for r in group], [1] * len(group), tuple(group[0]["behind"])
        ends = [trace(symbols, copies, after, s, False)[0] for s in range(4)]
        return {"chunk": key[1] + 1, "toward": key[1], "value": ends[:1] if len({*ends}) == 1 else None, "map": ends}

    on = F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at"))
    links = by_chunk(long.join(small_side(behind), on), states, whole)
    zero = F.array(F.lit(0).cast("long"))
    starts = behind.where("at = 0").select(F.col("of").alias("conv"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("toward"), zero.alias("value"), zero.alias("map"))
    firsts = resolved(links.unionByName(starts), apply_states, apply_states, folder, "states")
    return stash(firsts.join(behind, on, "left").select("conv", "chunk", "behind", F.col("value")[0].cast("int").alias("state")), folder, "settled")


# ---- results

def traced(rows: DataFrame, known: DataFrame | None, chunk: int) -> DataFrame:
    """For every chunk its sums and letters, and `lines`: the rows with something to write, and what.  spec is the
    inserted roles in front, k or the new role (nothing for a deleted row), and the inserted roles behind it."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    schema = (
        f"conv {kinds['conv']}, chunk long, cost long, letters string, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low {kinds['turn']}, high {kinds['turn']}, "
        f"lines array<struct<turn: {kinds['turn']}, role: string, digest: binary, spec: string>>"
    )

    def work(key: tuple, group: list[dict]) -> dict:
        symbols, copies = [symbol_of(r) for r in group], [r["n"] for r in group]
        last = group[-1]["before"] + 1 == group[-1]["total"]
        state = group[0].get("state") or 0
        _, cost, edits = trace(symbols, copies, tuple(group[0].get("behind") or END), state, last)
        post = edits.pop()[0] if last else ""
        letters, lines = [], []
        for i, (r, (added, letter, role)) in enumerate(zip(group, edits, strict=True)):
            letters.append("I" * len(added) + letter + "D" * (r["n"] - 1))
            tail = post if i + 1 == len(group) else ""
            if added or role or tail:
                lines.append({"turn": r["turn"], "role": r["role"], "digest": r["digest"], "spec": f"{added}|{role}|{tail}"})
        initials = [r["role"][:1] for r in group]
        turns = [r["turn"] for r in group if r["turn"] is not None]
        fault = [(r["blank"], not r["blank"] and not r["first"], not r["blank"] and r["first"] and r["truncated"]) for r in group]
        return {
            "cost": cost, "letters": "".join(letters) + "I" * len(post), "blank": sum(n for n, f in zip(copies, fault, strict=True) if f[0]),
            "duplicate": sum(n if f[1] else n - 1 for n, f in zip(copies, fault, strict=True) if not f[0]), "truncated": sum(f[2] for f in fault),
            "illegal": sum(n - 1 for n in copies) + sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:], strict=True)),
            "first": initials[0], "last": initials[-1], "turns": len({*turns}), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "lines": lines,
        }

    if known is not None:
        known = small_side(known.select(F.col("conv").alias("of"), F.col("chunk").alias("at"), "behind", "state"))
        rows = rows.join(known, F.col("conv").eqNullSafe(F.col("of")) & (F.col("chunk") == F.col("at")), "left").drop("of", "at")
    return by_chunk(rows, work, schema)


def summed(chunks: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for a conversation."""
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    part = F.struct("chunk", "letters", "first", "last", "turns", "low", "high", "illegal")
    found = chunks.groupBy("conv").agg(*sums, F.array_sort(F.collect_list(part)).alias("parts"))
    # what lies between two chunks
    pairs = F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: F.struct(F.concat(a["last"], b["first"]).alias("roles"), F.coalesce(a["high"] == b["low"], F.lit(False)).alias("same")))
    zero, legal = F.lit(0).cast("long"), sorted(LEGAL)
    total = lambda c: F.aggregate("parts", zero, lambda a, p: a + p[c])
    count = lambda test: F.size(F.filter("pairs", test)).cast("long")
    found = found.withColumn("pairs", pairs)
    turns = total("turns") - count(lambda p: p["same"])
    low, high = F.array_min(F.transform("parts", lambda p: p["low"])), F.array_max(F.transform("parts", lambda p: p["high"]))
    gaps = F.coalesce((high - low).cast("long") + 1 - turns, zero)
    illegal = total("illegal") + count(lambda p: ~p["roles"].isin(legal))
    return found.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), "cost", F.array_join(F.transform("parts", lambda p: p["letters"]), "").alias("audit"))


def written_lines(rows: DataFrame, chunks: DataFrame, *, digest: bool) -> DataFrame:
    """The repaired rows (conv, line, role, text), or with `digest` only (conv, repaired_sha256) over all lines
    `role:text`.  A conversation is streamed in order through one task, as its digest is one chain; a task holds one
    batch of rows."""
    kind = rows.schema["conv"].dataType.simpleString()
    keys = ["conv", "turn", "role", "digest"]
    edits = chunks.select("conv", F.explode("lines").alias("l")).select("conv", "l.turn", "l.role", "l.digest", F.lit(None).cast("string").alias("text"), "l.spec")
    texts = with_digest(rows).select(*keys, "text", F.lit(None).cast("string").alias("spec"))
    both = edits.unionByName(texts).repartition("conv").sortWithinPartitions(*keys, F.col("spec").isNull())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conv, role, text) of each line."""
        due = None  # the edit of the row that comes next, and its key
        for batch in batches:
            for conv, turn, role, mark, text, spec in zip(*[batch.column(c).to_pylist() for c in (*keys, "text", "spec")], strict=True):
                if spec is not None:
                    due = (conv, turn, role, mark), spec
                elif due and due[0] == (conv, turn, role, mark):
                    front, own, end = due[1].split("|")
                    for r in front:
                        yield conv, NAMES[r], ""
                    if own:
                        yield conv, NAMES.get(own, role), text
                    for r in end:
                        yield conv, NAMES[r], ""
                    due = None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in groupby(lines(batches), key=lambda x: x[0]):
            sha, first = hashlib.sha256(), True
            for _, role, text in group:
                sha.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
            out.append((conv, sha.hexdigest()))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist([{"conv": c, "repaired_sha256": d} for c, d in out], found)
                out = []
        yield pa.RecordBatch.from_pylist([{"conv": c, "repaired_sha256": d} for c, d in out], found)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for _, group in groupby(lines(batches), key=lambda x: x[0]):
            for i, (conv, role, text) in enumerate(group):
                out.append({"conv": conv, "line": i, "role": role, "text": text})
                size += 100 + len(text)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, found)
                    out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, found)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"conv {kind}, repaired_sha256 string" if digest else f"conv {kind}, line long, role string, text string"
    found = to_arrow_schema(StructType.fromDDL(schema))
    return both.mapInArrow(digests if digest else records, schema)


def repair(rows: DataFrame, *, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """For conversations (conv, turn, role, text): the report (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit), and the chunks' edits, from which written_lines() makes the repaired rows.

    Rows stand in the order of turns, nulls first; rows of one turn in that of their roles and then of their texts'
    SHA-256.  Roles and texts must not be null.  A role without letters has no initial and can't be kept.  Rows that
    are repeated are duplicates of the first.  conv may be null, which is one conversation.  Very long texts count
    by their digest but for the repaired rows.  Columns beside these four aren't read.  No rows, no result.
    """
    folder = shared_dir(rows.sparkSession)
    marked = faults(rows.select("conv", "turn", "role", "text"), folder, chunk)
    chunks = stash(traced(marked, settled(marked, folder, chunk), chunk), folder, "chunks")
    return summed(chunks), chunks


def op13(spark, sf_dir: str, *, chunk: int = CHUNK) -> DataFrame:
    """op13_conversation_repair: one row for each conversation, after damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    report, chunks = repair(rows, chunk=chunk)
    digests = written_lines(rows, chunks, digest=True).withColumnRenamed("conv", "of2")
    out = conversations.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("of2")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


ORACLE = rf"""
WITH RECURSIVE fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor({CRC.format(text="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}, 4294967295) % 20 AS fate FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS former
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
marked AS (SELECT conv_id, turn, i, role, text, former, regexp_full_match(text, '[\x20\x09-\x0D]*') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
added(s, s1, c, letters, roles) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']),
  (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])),
moves(s1, s2, letter, initial, new) AS (VALUES (0, 0, 'D', '', ''), (1, 1, 'D', '', ''), (2, 2, 'D', '', ''), (3, 3, 'D', '', ''), (0, 2, 'R', '', 'user'), (1, 2, 'R', '', 'user'), (2, 3, 'R', '', 'assistant'), (3, 2, 'R', '', 'user'),
  (0, 1, 'K', 's', ''), (0, 2, 'K', 'u', ''), (1, 2, 'K', 'u', ''), (2, 3, 'K', 'a', ''), (3, 2, 'K', 'u', '')),
steps AS (SELECT a.s, m.*, a.c, a.letters, a.roles FROM added a JOIN moves m ON m.s1 = a.s1),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT d.conv_id, m.i, t.s2, min({{'cost': (d.best.cost + t.c + CASE WHEN t.letter = 'D' THEN 4 ELSE CASE WHEN t.letter = 'R' THEN 3 ELSE 0 END + CASE WHEN m.cut THEN 3 ELSE 0 END END)::BIGINT,
    'audit': d.best.audit || t.letters || t.letter, 'lines': d.best.lines || t.roles || CASE t.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [t.new || ':' || m.text] ELSE [m.role || ':' || m.text] END}})
  FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1
  JOIN steps t ON t.s = d.s AND (t.letter = 'D' OR NOT (m.blank OR m.again)) AND (t.letter <> 'K' OR t.initial = m.role[1])
  GROUP BY d.conv_id, m.i, t.s2),
ends AS (SELECT d.conv_id, d.i, min({{'cost': (best.cost + a.c)::BIGINT, 'audit': best.audit || a.letters, 'lines': best.lines || a.roles}}) AS best
  FROM dp d JOIN added a ON a.s = d.s AND a.s1 IN (0, 3) GROUP BY d.conv_id, d.i),
told AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
  count(*) FILTER (WHERE NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (WHERE former IS NOT NULL AND (former || role[1]) NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = coalesce(t.n, 0)
"""
