"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text; longer lines are cut into overlapping windows.  A template is found in a block if the block
has at least `threshold` of the template's distinct words.  The join finds every such pair:

* Length: blocks with fewer distinct words of templates than the least that a template needs are out as soon as their
  lines are cut into words; of the others only these words travel.
* Words of the templates are counted over all blocks that are left and ordered from rare to frequent.
* Prefix: of a template of n words that needs k, one of the n - k + 1 rarest must be in the block, and be among the
  block's own rarest as well.  Only these words of templates are indexed, and the words of blocks probe the index.
* Length again: blocks with fewer than k words of templates are out.
* Position: behind the word they met by, both sides must have enough words left.
* What passes is verified by the intersection of both sets.

Templates are a parameter; what is broadcast is their words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.decontam import QUIET, WORD, loud, words_of
from lumenfold.llm.exact_dedup import UPPER, ascii_lower
from lumenfold.llm.shared import shared_dir, small_side, stash
from lumenfold.llm.textnp import lower, range_digests, ranges, text_chunks, words

#: Phrases and their labels, fixed values of the contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label and words of the notices that are looked for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License"),
)
#: Share of a template's distinct words that a block must have; with it short notices must be complete.
THRESHOLD = 0.9
#: Words of a window of a long line; the next one starts after half of them, so no notice of half a window is cut.
WINDOW = 64
#: Which bytes separate words.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def needed(size: int, threshold: float) -> int:
    """The least number of words that reaches the threshold."""
    return max(1, math.ceil(threshold * size - 1e-9))


def template_words(text: str) -> list[str]:
    return sorted({*re.findall(WORD, text.translate(str.maketrans(UPPER, UPPER.lower())))})


def pick(batches: Iterator[pa.RecordBatch], known: list[str], least: int, window: int, pieces: bool) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, fp, line, body) to (id, fp, line, own) for every block of a line that has `least` distinct words
    of `known`, own; with `pieces` the block's text is added."""
    names, sizes = pa.array(known, pa.string()), np.array([len(w.encode()) for w in known], np.int64)
    spelled, at = np.frombuffer("".join([*known, " "]).encode(), np.uint8), np.cumsum(sizes) - sizes
    one, two = range_digests(spelled, at, at + sizes)
    order = np.argsort(one)
    likely = np.zeros((64, 256), bool)  # by a word's size and first byte
    likely[np.minimum(sizes, 63), spelled[at]] = True
    step = max(window // 2, 1)
    for batch in batches:
        for first, data, offsets in text_chunks(batch["body"]):
            data = lower(data)
            starts, ends, firsts = words(data, offsets, BETWEEN)
            hit = np.flatnonzero(likely[np.minimum(ends - starts, 63), data[starts]])
            a, b = range_digests(data, starts[hit], ends[hit])
            found = np.minimum(np.searchsorted(one, a, sorter=order), max(len(order) - 1, 0))
            word = order[found] if len(order) else found
            same = (one[word] == a) & (two[word] == b)
            hit, word = hit[same], word[same]
            line = np.searchsorted(firsts, hit, "right") - 1
            n, place = np.diff(firsts)[line], hit - firsts[line]
            last = np.where(n <= window, 0, (np.maximum(n - step, 1) - 1) // step)
            low, high = np.maximum(place - window + step, 0) // step, np.minimum(place // step, last)
            times = high - low + 1
            block, line, word = ranges(low, times), np.repeat(line, times), np.repeat(word, times)
            many = int(block.max(initial=0)) + 1
            key = np.unique((line * many + block) * max(len(known), 1) + word)
            group, own = np.divmod(key, max(len(known), 1))
            blocks, count = np.unique(group, return_counts=True)
            own, blocks, count = own[np.repeat(count >= least, count)], blocks[count >= least], count[count >= least]
            if not len(blocks):
                continue
            line, block = np.divmod(blocks, many)
            rows = pa.array(first + line)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), names.take(pa.array(own)))
            out = [batch[c].take(rows) for c in ("id", "fp", "line")] + [lists]
            if pieces:
                head = firsts[line] + block * step
                tail = np.where(np.diff(firsts)[line] <= window, firsts[line + 1], np.minimum(head + window, firsts[line + 1])) - 1
                out.append(pa.array([data[x:y].tobytes().decode(errors="replace") for x, y in zip(starts[head], ends[tail])], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "fp", "line", "own", "piece"][: len(out)])


def candidates(docs: DataFrame, sets: list[tuple[str, list[str]]], threshold: float, id_col: str, text_col: str, separator: str, window: int, pieces: bool = False) -> DataFrame:
    """(id, fp, line, own) and, if wanted, piece (its text) of every block with as many distinct words of templates, own,
    as any template needs; fp is the text's hash."""
    known, least = sorted({w for _, words in sets for w in words}), min((needed(len(words), threshold) for _, words in sets), default=1)
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), F.posexplode(F.split(F.col(f"`{text_col}`"), separator)).alias("line", "body"))
    schema = f"id {lines.schema["id"].dataType.simpleString()}, fp long, line int, own array<string>" + ", piece string" * pieces
    return lines.mapInArrow(lambda it: pick(it, known, least, window, pieces), schema)


def rare_first(near: DataFrame, vocabulary: list[str]) -> list[str]:
    """The words of the templates, those first that the candidates have least: counts over all of them, one for each
    word of the templates."""
    counts = {r["word"]: r["n"] for r in near.select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def index_of(spark: SparkSession, templates: list[tuple[str, list[str]]], order: list[str], threshold: float) -> DataFrame:
    """(token, label, place, need, template): the rarest words of each template, as many as one must be met by."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for label, words in templates:
        words = sorted(words, key=rank.__getitem__)
        need = needed(len(words), threshold)
        rows += [(w, label, i + 1, need, words) for i, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "token string, label string, place int, need int, template array<string>")


def found_blocks(docs: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", window: int = WINDOW, with_words: bool = True) -> DataFrame:
    """(id, fp, line, label, containment, words): every block that has the threshold of a template, once for each word
    that both have among their rarest; without the last column if with_words is off."""
    sets = [(label, template_words(text)) for label, text in templates]
    sets = [(label, words) for label, words in sets if words]
    near = stash(candidates(docs, sets, threshold, id_col, text_col, separator, window, with_words), shared_dir(docs.sparkSession), "candidates")
    order = rare_first(near, sorted({w for _, words in sets for w in words}))
    index = index_of(docs.sparkSession, sets, order, threshold)
    known = F.array(*[F.lit(w) for w in order]) if order else F.array().cast("array<string>")
    probes = near.select("*", F.explode("own").alias("token")).join(F.broadcast(index), "token")
    met = probes.withColumn("own", F.array_intersect(known, "own")).withColumn("at", F.array_position("own", F.col("token")).cast("int"))
    left = F.least(F.size("template") - F.col("place"), F.size("own") - F.col("at")) + 1
    met = met.where((F.size("own") >= F.col("need")) & (F.col("at") <= F.size("own") - F.col("need") + 1) & (left >= F.col("need")))
    met = met.withColumn("both", F.size(F.array_intersect("own", "template"))).where("both >= need")
    return met.select("id", "fp", "line", "label", (F.col("both") / F.size("template")).alias("containment"), *([words_of(F.col("piece")).alias("words")] if with_words else []))


def spoken_as(phrases: dict[str, str]) -> str:
    """Pattern of the phrases' words and what may stand between them, in Java and in RE2; words may go on at both ends."""
    return "|".join(f"{QUIET}+".join(re.escape(w) for w in p.split()) for p in phrases)


def word_counts(phrases: dict[str, str]):
    """Column function of texts: n, the number of words, and may, whether the words of a phrase stand in the text, if
    only as parts of others."""

    @F.arrow_udf("n long, may boolean")
    def counts(texts: pa.Array) -> pa.Array:
        n = [np.diff(words(data, offsets, BETWEEN)[2]) for _, data, offsets in text_chunks(texts)]
        may = pc.match_substring_regex(pc.ascii_lower(texts), spoken_as(phrases))
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *n])), may], names=["n", "may"])

    return counts


def phrase_columns(text: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base (labels) of whole texts; `low` must be the lower-cased text, and n_words
    its number of words.  No phrase begins with what another ends with, so places never overlap."""
    pattern = f"(?:^|(?<={QUIET}))(?:{spoken_as(phrases)})(?={QUIET}|\\z)"
    n = lambda c: F.size(loud(c)).cast("long")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    some = F.col("n_base") > 0
    spoken = F.transform(F.col("hits"), lambda h: F.array_join(loud(h), " "))
    labels = F.array(*[F.when(F.array_contains("spoken", p), F.lit(label)) for p, label in phrases.items()])
    return {
        "hits": hits, "n_base": F.size("hits").cast("long"), "spoken": F.when(some, spoken), "first_word": F.when(some, n(F.element_at(parts, 1))),
        "last_word": F.when(some, F.col("n_words") - n(F.element_at(parts, -1)) - n(F.element_at("hits", -1))), "base": F.when(some, F.array_compact(labels)).otherwise(F.array().cast("array<string>")),
    }


def scan(docs: DataFrame, *, templates=TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", separator: str = "\n", window: int = WINDOW) -> DataFrame:
    """(id, RESULT) for each row of docs: n_words; n_base, first_word and last_word of the phrases (null without any);
    base_labels of the phrases and labels of both methods, sorted; score: 1 with a phrase, else the best containment
    that reaches the threshold, else 0.

    Null text is empty and has no words.  Rows that repeat an id are told apart by their texts; rows that are repeated
    each get the same result, also with a null id.  Very long texts are cut into blocks, and phrases are sought in
    them as a whole.  Other columns aren't read.  An empty table gives no rows.
    """
    folder = shared_dir(docs.sparkSession)
    found = found_blocks(docs, templates=templates, threshold=threshold, id_col=id_col, text_col=text_col, separator=separator, window=window, with_words=False)
    found = found.groupBy("id", "fp").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = stash(found.withColumnsRenamed({"id": "of", "fp": "of_fp"}), folder, "found")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("fp"), text.alias("text"))
    rows = rows.withColumn("counts", word_counts(phrases or PHRASES)("text"))
    rows = rows.select("id", "fp", F.col("counts.n").alias("n_words"), F.when(F.col("counts.may"), ascii_lower(F.col("text"))).otherwise("").alias("low"))
    for name, column in phrase_columns(F.col("low"), phrases or PHRASES).items():
        rows = rows.withColumn(name, column)
    rows = rows.drop("low", "hits", "spoken").join(small_side(found), F.col("id").eqNullSafe(F.col("of")) & (F.col("fp") == F.col("of_fp")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op12(spark, sf_dir: str) -> DataFrame:
    """op12_license_scan: one row per document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SETS = ", ".join(f"('{label}', {template_words(text)!r}, {needed(len(template_words(text)), THRESHOLD)})" for label, text in TEMPLATES)
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{WORD}') AS w FROM d),
p(words, label) AS (VALUES {", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())}),
places AS (SELECT r, i - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w) x JOIN p ON x.w[i] = p.words[1] AND x.w[i:i + len(p.words) - 1] = p.words),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY r),
lines AS (SELECT r, regexp_extract_all(body, '{WORD}') AS w FROM (SELECT r, unnest(string_split(low, chr(10))) AS body FROM d)),
cut AS (SELECT r, list_distinct(w[s:s + {WINDOW - 1}]) AS b FROM (SELECT r, w, unnest(CASE WHEN len(w) <= {WINDOW} THEN [1] ELSE range(1, len(w) - {WINDOW // 2} + 1, {WINDOW // 2}) END) AS s FROM lines)),
t(label, words, need) AS (VALUES {_SETS}),
near AS (SELECT r, list(DISTINCT label) AS more, max(n / size) AS best FROM (SELECT r, label, need, len(words) AS size, len(list_intersect(b, words)) AS n FROM cut, t) WHERE n >= need GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN near USING (r)
"""
