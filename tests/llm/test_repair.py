"""Conversation repair against a sequential version, in one chunk and in many."""

import hashlib
import re
from zlib import crc32

import duckdb
import numpy as np
import pytest

from lumenfold.llm import repair

ROWS = "conv_id long, turn long, role string, text string"


def damage(rows):
    put = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        fate, role, text = crc32(f"{put(conv)}:{put(turn)}".encode()) % 20, put(role), put(text)
        if fate:
            row = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            yield from [row] * (2 if fate == 3 else 1)


def sequential(rows):
    """Costs and edits of whole conversations, forwards, over all states."""
    out = []
    hurt = list(damage(rows))
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            loud = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not loud else "duplicate" if (role, text) in seen else "truncated" if loud[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))

        def inserts(best):
            for _ in range(3):
                for s, (cost, audit, lines) in list(best.items()):
                    added, to = ("assistant", 3) if s == 2 else ("user", 2)
                    new = (cost + 3, audit + "I", [*lines, f"{added}:"])
                    best[to] = min(best.get(to, new), new, key=lambda x: x[:2])
            return best

        best = {0: (0, "", [])}
        for (_, _, role, text), fault in zip(own, faults, strict=True):
            new = {}

            def offer(s, cost, audit, lines, new=new):
                if s not in new or (cost, audit) < new[s][:2]:
                    new[s] = (cost, audit, lines)

            for s, (cost, audit, lines) in inserts(best).items():
                offer(s, cost + 4, audit + "D", lines)
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    added, to = ("assistant", 3) if s == 2 else ("user", 2)
                    offer(to, cost + 3 + more, audit + "R", [*lines, f"{added}:{text}"])
                    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                    if kept is not None:
                        offer(kept, cost + more, audit + "K", [*lines, f"{role}:{text}"])
            best = new
        ended = [v for s, v in inserts(best).items() if s in (0, 3)]
        cost, audit, lines = min(ended, key=lambda x: x[:2])
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple(map(str, r)))


def run(spark, rows, tmp_path, extra="", **how):
    spark.createDataFrame([(*r, *([1, "x", True] if extra else [])) for r in rows], ROWS + extra).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted((tuple(r) for r in repair.op13(spark, str(tmp_path), **how).collect()), key=lambda r: tuple(map(str, r)))


def made_up(seed, n, convs):
    rng = np.random.default_rng(seed)
    roles, texts = ["user", "assistant", "system", "tool", "User", None, "assistant", "user"], ["Yes.", "No!", "and then", " \t", "", None, "Why? ", "ok. ", "　"]
    return [(int(rng.integers(convs)), None if rng.random() < 0.04 else int(rng.integers(n // convs)), roles[rng.integers(8)], f"{rng.integers(40)} {texts[rng.integers(9)] or ''}" if rng.random() < 0.6 else texts[rng.integers(9)]) for _ in range(n)]


def test_repair_equals_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = c.sql(repair.ORACLE)
    df = repair.op13(spark, sf_dir)
    assert df.columns == want.columns
    assert sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(map(str, r))) == sorted(want.fetchall(), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("chunk", [10_000, 4])
def test_repair_equals_sequential(spark, tmp_path, chunk):
    """Random conversations with one that holds most rows, ties, nulls in any column, odd roles, repeated rows, a long
    text, clashing columns; and with runs in which no chunk settles the costs of another."""
    rows = made_up(1, 120, 6) + [(7, i % 50, "user" if i % 2 else "assistant", f"t{i}.") for i in range(90)]
    rows += [(8, i, "tool", f"cut {i}") for i in range(40)] + [(9, i, "system", f"cut {i}") for i in range(30)] + [(10, i, "user", "same.") for i in range(30)]
    rows += [(None, 1, "user", "q?"), (None, None, "assistant", "a."), (11, 0, "user", ""), (12, 3, "user", "z" * 300_000 + "."), rows[0], rows[0]]
    rows += [(13, t, "user", "gone.") for t in range(200) if crc32(f"13:{t}".encode()) % 20 == 0]
    got = run(spark, rows, tmp_path, ", chunk long, before string, first boolean", chunk=chunk)
    assert got == sequential(rows)
    assert next(r for r in got if r[0] == 13) == (13, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_nothing(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_repaired_rows(spark):
    """The operator's own output: rows that alternate."""
    rows = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Why?"), (1, 3, "user", "Why?"), (1, 4, "tool", "out")], "conv long, turn long, role string, text string")
    report, chunks = repair.repair(rows)
    assert report.first()["audit"] == "KIKKDR"
    got = repair.written_lines(rows, chunks, digest=False).orderBy("line").collect()
    assert [(r["role"], r["text"]) for r in got] == [("system", "Be brief."), ("user", ""), ("assistant", "Yes."), ("user", "Why?"), ("assistant", "out")]


def test_speculative_costs_compose():
    """Chunks composed by their speculative vectors give the costs of one sweep, from any costs behind them."""
    rng = np.random.default_rng(3)
    kinds = ["u", "a", "s", "t", "ut", "at", "st", "tt", ""]
    for _ in range(300):
        parts = [[kinds[k] for k in rng.integers(0, 9, rng.integers(1, 6))] for _ in range(3)]
        costs = repair.END
        for symbol in reversed(sum(parts, [])):
            costs = repair.before_row(costs, symbol)[0] if symbol else costs
        maps = [np.asarray(repair.speculate(p)) for p in parts]
        end = np.asarray(repair.END)
        one_by_one = repair.apply_costs(maps[0], repair.apply_costs(maps[1], repair.apply_costs(maps[2], end)))
        at_once = repair.apply_costs(repair.compose_costs(maps[0], repair.compose_costs(maps[1], maps[2])), end)
        assert tuple(one_by_one) == tuple(at_once) == costs
