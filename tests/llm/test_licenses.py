"""License scans against SQL and brute force."""

import random
import re

import duckdb
import pytest

from lumenfold.llm import licenses

WORD = re.compile(licenses.WORD)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(text, templates, threshold, window):
    words = WORD.findall(low(text))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    best, labels = 0.0, set()
    for line in low(text).split("\n"):
        own = WORD.findall(line)
        cuts = [own] if len(own) <= window else [own[s : s + window] for s in range(0, len(own) - window // 2, window // 2)]
        for cut in cuts:
            for label, notice in templates:
                want = {*WORD.findall(low(notice))}
                share = len(want & {*cut}) / len(want)
                if share >= threshold - 1e-12:
                    best = max(best, share)
                    labels.add(label)
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if at else best)


def test_licenses_equal_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want, df = c.sql(licenses.ORACLE), licenses.op12(spark, sf_dir)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize(("threshold", "window"), [(0.9, 64), (0.6, 10), (1.0, 7)])
def test_licenses_equal_brute_force(spark, threshold, window):
    """Notices with words lost, swapped and added, in short and very long lines; phrases over punctuation and line ends;
    nulls, empty and repeated rows, ties, a text that a third of the rows share, clashing columns."""
    rng = random.Random(2)
    notices = [text for _, text in licenses.TEMPLATES]
    filler = sorted({w for n in notices for w in n.split()}) + "mit the und café 日本 x1".split()
    texts = [None, "", " \n\n ", "cc\nBY", "acc by", "cc byx", "CC-BY cc.by All rights, reserved.", "general public license" * 2, "GENERAL public\tLicense; all rights reserved all rights reserved", "é cc by é"]
    for _ in range(80):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(3)):
            words.pop(rng.randrange(len(words)))
        rng.shuffle(words)
        around = rng.choices(filler, k=rng.choice([0, 3, 40]))
        texts.append(" ".join(around[:20] + words + around[20:]) + rng.choice(["", "\n", "\nmore words"]))
    texts += ["Released under the MIT License."] * 40 + ["lorem " * 200_000 + "Licensed under CC BY-NC 4.0. " + "ipsum " * 1000]
    rows = [(i if i != 5 else None, t, "a", 1, [1]) for i, t in enumerate(texts)]
    rows.append(rows[12])
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, line int, words array<int>")
    got = licenses.scan(df, threshold=threshold, window=window).collect()
    want = [(r[0], *brute_force(r[1], licenses.TEMPLATES, threshold, window)) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_blocks_of_one_document(spark):
    df = spark.createDataFrame([(1, "intro\nReleased under the MIT License.\nend")], "doc_id long, text string")
    got = licenses.found_blocks(df).select("line", "label", "containment").distinct().collect()
    assert [tuple(r) for r in got] == [(1, "mit", 1.0)]
    assert licenses.found_blocks(df, templates=(("none", "..."),)).count() == 0


def windows(text, window):
    """(line, words) of every block of a text."""
    for line, body in enumerate(low(text).split("\n")):
        own = WORD.findall(body)
        yield from ((line, cut) for cut in ([own] if len(own) <= window else [own[s : s + window] for s in range(0, len(own) - window // 2, window // 2)]))


@pytest.mark.parametrize(("threshold", "window"), [(0.9, 64), (0.6, 10), (1.0, 7)])
def test_only_blocks_that_can_hold_a_template_are_joined(spark, threshold, window):
    """Of the blocks those travel that have as many words of templates as any template needs, with these words alone."""
    rng = random.Random(5)
    sets = [(label, licenses.template_words(text)) for label, text in licenses.TEMPLATES]
    known, least = {w for _, s in sets for w in s}, min(licenses.needed(len(s), threshold) for _, s in sets)
    filler = sorted(known)[:40] + "é É日本 x1 thé a\x00b _ gplé mit the MIT 😀the \x7fthe".split(" ")
    texts = [" ".join(rng.choices(filler, k=rng.choice([0, 3, 9, 30, 200]))) + rng.choice(["", "\n", "\n\nmore the of\n"]) for _ in range(60)]
    texts += [None, "", "\n", "lorem ipsum\n" * 500, "lorem " * 3000 + "Licensed under CC BY-NC " + "ipsum " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.candidates(df, sets, threshold, "doc_id", "text", "\n", window, True).collect()
    want = [(i, line, sorted(known & {*cut}), cut) for i, t in enumerate(texts) for line, cut in windows(t, window) if len(known & {*cut}) >= least]
    assert sorted((r["id"], r["line"], sorted(r["own"]), WORD.findall(r["piece"])) for r in got) == sorted(want)


def test_scan_matches_no_negated_class(spark):
    """Java matches negated classes at a cost that grows with the threads of an executor: no step over texts does so."""
    df = spark.createDataFrame([(1, "a"), (2, "Released under the MIT License")], "doc_id long, text string")
    for plan in (licenses.scan(df), licenses.found_blocks(df), df.select(licenses.words_of(df["text"]))):
        assert "[^" not in plan._jdf.queryExecution().toString()


def test_words_of_odd_texts(spark):
    rng = random.Random(6)
    texts = ["", None, " ", "a", "..A..b", "É.é", "\x00a\x7fb\x80c d", "😀 x😀y", "a\r\nb\tC"] + ["".join(rng.choices("aZ9 .\n\x00\x7f\u0080é日😀", k=30)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = df.select("i", licenses.words_of(df["t"]).alias("w")).collect()
    assert {r["i"]: r["w"] for r in got} == {i: WORD.findall(low(t)) for i, t in enumerate(texts)}
    n = df.where("t is not null").select("i", licenses.word_counts(licenses.PHRASES)("t")["n"].alias("n")).collect()
    assert {r["i"]: r["n"] for r in n} == {i: len(WORD.findall(low(t))) for i, t in enumerate(texts) if t is not None}
