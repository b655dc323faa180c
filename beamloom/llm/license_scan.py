"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words (see WORD; A to Z are lower-cased) are cut into blocks: for a class of templates with
stride s, block b has the words b * s to b * s + 2 * s - 1, so that any run of s words lies in a
block. A template is the set of its words. A block meets a template if it holds `need` of its
words: the threshold's share, rounded up, or all of them in notices (NOTICE words at most).

The join is exact. The words of all templates are put in the order of their frequency in the
corpus, rarest first. Of a template only the first ``size - need + 1`` words are looked up (prefix
filter), and so for a block; a block with fewer than ``need`` template words is no candidate (length
filter), nor is a pair whose words behind the shared one are too few (positional filter). Pairs
that are left are counted in full. Of several templates of one family in one block the best one counts:
the highest containment, then the most words, then the smallest label.

The frequencies come from all rows (partial sums by task, then one row a template word). A second
pass makes, for each document, the base measures and the blocks that hold a looked-up word; these
rows are a small part of the texts. They are stored once, joined with the templates' words
(a broadcast whose size the templates bound) and summed by document. No row is dropped and no
block depends on another one.

Defined results: a null text is an empty one (no words, no labels, score 0); a null id stays null;
repeated rows are judged and returned each; an empty table gives an empty result; further columns
are not read. Very long texts are read in pieces of PIECE bytes; what stays is one number a word.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.llm.shared import returned_memory, short_batches, written

#: Words of lower-cased text, as UTF-8 bytes: digits, letters and all that is beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Templates of up to NOTICE words are notices: they differ in single words, so all are asked for.
THRESHOLD, NOTICE, PIECE = 0.8, 13, 1 << 20


@dataclasses.dataclass(frozen=True)
class Template:
    """A license's text, or a notice that names it. Of templates of one family a block takes the best."""

    label: str
    family: str
    text: str


#: Phrases whose words stand one after the other, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and passages of well-known licenses. Notices are looked for in blocks of twice the longest one.
TEMPLATES = (
    Template("mit", "mit", "Released under the MIT License."),
    Template("apache-2", "apache", "Licensed under the Apache License, Version 2.0."),
    Template("bsd", "bsd", "Released under the BSD License."),
    Template("mpl-2", "mpl", "Licensed under the Mozilla Public License, Version 2.0."),
    Template("gpl-3", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-2", "gnu", "This work is licensed under the GNU General Public License, version 2."),
    Template("agpl-3", "gnu", "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("lgpl-3", "gnu", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("cc-by-nc", "cc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa", "cc", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-nc", "cc", "Creative Commons Attribution NonCommercial 4.0 International License"),
    Template("cc-by-sa", "cc", "Creative Commons Attribution ShareAlike 4.0 International License"),
    Template(
        "mit",
        "permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    Template(
        "isc",
        "permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "bsd",
        "redistribution",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    Template(
        "apache-2",
        "compliance",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at. Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    Template(
        "gpl",
        "free-software",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version of the License, or at your option any later version.",
    ),
)


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclasses.dataclass(frozen=True)
class _Plan:
    """Templates as sorted ranks of words, by class; `needs` and `looked` (words to look up) belong to a class too."""

    rank: dict[bytes, int]
    strides: tuple[int, ...]
    rows: tuple[tuple[int, int, list[int], int], ...]  # number, class, ranks, need

    def looked(self, kind: int) -> set[int]:
        return {r for _, k, ranks, need in self.rows if k == kind for r in ranks[: len(ranks) - need + 1]}

    def least(self, kind: int) -> int:
        return min(need for _, k, _, need in self.rows if k == kind)


def needed(size: int, notice: bool, threshold: float) -> int:
    return size if notice else min(size, int(np.ceil(threshold * size - 1e-9)))


def _strides(templates) -> list[int]:
    """The stride of each template's class: notices in one, longer texts in another."""
    sizes = [len(words(t.text)) for t in templates]
    if not sizes or min(sizes) == 0:
        raise ValueError("templates need words")
    notices = [n for n in sizes if n <= NOTICE]
    return [max(notices) if n <= NOTICE else max(sizes) for n in sizes]


def _planned(templates, ordered: list[bytes], threshold: float) -> _Plan:
    rank = {w: i for i, w in enumerate(ordered)}
    strides = _strides(templates)
    kinds = sorted(set(strides))
    rows = []
    for number, (t, stride) in enumerate(zip(templates, strides, strict=True)):
        ranks = sorted({rank[w] for w in words(t.text)})
        rows.append((number, kinds.index(stride), ranks, needed(len(ranks), stride <= NOTICE, threshold)))
    return _Plan(rank, tuple(kinds), tuple(rows))


class _Ranks(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


def _ranks(text: str | None, rank: _Ranks) -> np.ndarray:
    """The rank of each word of a text, -1 for words of no template."""
    data, at, parts = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while at < len(data):
        end = at + PIECE
        if end < len(data):  # no cut inside of a word
            found = BREAK.search(data, end)
            end = found.start() if found else len(data)
        found = WORD.findall(data, at, end)
        parts.append(np.fromiter(map(rank.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _ordered(docs: DataFrame, text: str, vocabulary: list[bytes]) -> list[bytes]:
    """The templates' words, rarest in the corpus first; equal ones in the order of their bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, total = _Ranks({w: i for i, w in enumerate(vocabulary)}), np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(_ranks(value.as_py(), rank) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total[1:])], ["word", "n"])

    with short_batches(docs.sparkSession):
        sums = docs.select(text).mapInArrow(returned_memory(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word of the templates
    seen = {r["word"]: r["n"] for r in sums}
    return [vocabulary[i] for i in sorted(range(len(vocabulary)), key=lambda i: (seen.get(i, 0), vocabulary[i]))]


BLOCK = "array<struct<kind:int,start:long,ranks:array<int>>>"


def _scanned(docs: DataFrame, doc_id: str, text: str, plan: _Plan, phrases: dict[str, str]) -> DataFrame:
    """Base measures and candidate blocks of each row."""
    spoken = [([plan.rank[w] for w in words(p)], label) for p, label in phrases.items()]
    top = len(plan.rank)
    looked = np.zeros((len(plan.strides), top + 1), bool)  # the last one stands for words of no template
    for kind in range(len(plan.strides)):
        looked[kind, list(plan.looked(kind))] = True
    least = [plan.least(kind) for kind in range(len(plan.strides))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = _Ranks(plan.rank)
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "blocks")}
            for value in batch.column(1):
                ids = _ranks(value.as_py(), rank)
                places, labels = [], set()
                for phrase, label in spoken:
                    n = len(ids) - len(phrase) + 1
                    if n > 0:
                        same = np.flatnonzero(ids[:n] == phrase[0])
                        for i, r in enumerate(phrase[1:], 1):
                            same = same[ids[same + i] == r]
                        if len(same):
                            places += same.tolist()
                            labels.add(label)
                blocks = []
                for kind, stride in enumerate(plan.strides):
                    hit = np.flatnonzero(looked[kind][ids]) // stride
                    for b in np.union1d(hit, hit[hit > 0] - 1).tolist():
                        held = np.unique(ids[b * stride : (b + 2) * stride])
                        held = held[held >= 0]
                        if len(held) >= least[kind]:
                            blocks.append((kind, b * stride, held.tolist()))
                out["n_words"].append(len(ids))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(sorted(labels))
                out["blocks"].append([{"kind": k, "start": s, "ranks": r} for k, s, r in blocks])
            types = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("ranks", pa.list_(pa.int32()))]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], ["doc_id", *out])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks {BLOCK}"
    return rows.mapInArrow(returned_memory(scan), schema)


def matched_blocks(blocks: DataFrame, templates: tuple[Template, ...], plan: _Plan) -> DataFrame:
    """blocks (row, kind, start, ranks) joined with the templates they meet: row, kind, start, template, family, label, size, overlap."""
    spark = blocks.sparkSession
    index = [
        (kind, r, i, number, templates[number].family, templates[number].label, ranks, need)
        for number, kind, ranks, need in plan.rows
        for i, r in enumerate(ranks[: len(ranks) - need + 1])
    ]
    looked = spark.createDataFrame(index, "kind int, rank int, i int, template int, family string, label string, t_ranks array<int>, need int")
    each = blocks.select("*", F.posexplode("ranks").alias("j", "rank"))
    size, n = F.size("t_ranks"), F.size("ranks")
    pairs = each.join(F.broadcast(looked), ["kind", "rank"]).filter(  # as many rows as the templates' prefixes have words
        (n >= F.col("need")) & (F.col("j") <= n - F.col("need")) & (1 + F.least(size - F.col("i") - 1, n - F.col("j") - 1) >= F.col("need"))
    )
    met = pairs.withColumn("overlap", F.size(F.array_intersect("ranks", "t_ranks"))).filter(F.col("overlap") >= F.col("need"))
    return met.select("row", "kind", "start", "template", "family", "label", size.alias("size"), "overlap")


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def license_scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks (blocks that meet a template).

    The score is the highest containment of a template in a block, 1 where a phrase stands, 0 without either.
    """
    vocabulary = sorted({w for t in templates for w in words(t.text)} | {w for p in phrases for w in words(p)})
    plan = _planned(templates, _ordered(docs, text, vocabulary), threshold)
    found = written(_scanned(docs, doc_id, text, plan, phrases).withColumn("__row", F.monotonically_increasing_id()), "license-blocks")
    blocks = found.select(F.col("__row").alias("row"), F.inline("blocks"))
    met = matched_blocks(blocks, templates, plan)
    best = F.min(F.struct((-F.col("overlap") / F.col("size")).alias("c"), (-F.col("size")).alias("n"), "label")).alias("best")
    per_block = met.groupBy("row", "kind", "start", "family").agg(best)
    per_row = per_block.groupBy("row").agg(F.collect_set("best.label").alias("more"), (-F.min("best.c")).alias("c"), F.count_distinct("kind", "start").alias("k"))
    joined = found.drop("blocks").join(per_row, F.col("__row") == F.col("row"), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", _joined(F.col("base_labels")).alias("base_labels"),
        _joined(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("score"), F.coalesce("k", F.lit(0)).cast("long").alias("n_blocks"),
    )


def scan_sql(docs: str, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> str:
    """The same result in SQL, without filters: all words of all blocks against all templates."""
    strides = _strides(templates)
    values = []
    for number, (t, stride) in enumerate(zip(templates, strides, strict=True)):
        own = sorted(set(words(t.text)))
        values += [f"({number}, {stride}, '{t.family}', '{t.label}', '{w.decode()}', {len(own)}, {needed(len(own), stride <= NOTICE, threshold)})" for w in own]
    said = [f"({i}, '{label}', [{', '.join(repr(w.decode()) for w in words(p))}])" for i, (p, label) in enumerate(phrases.items())]
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {docs}),
w AS MATERIALIZED (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
t(template, stride, family, label, word, size, need) AS (VALUES {', '.join(values)}),
said(n, label, ps) AS (VALUES {', '.join(said)}),
base AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS ls FROM w JOIN said ON word = ps[1] JOIN d USING (rid) WHERE ws[p + 1:p + len(ps)] = ps GROUP BY rid),
held AS (SELECT rid, template, stride, family, label, size, need, p // stride - o AS b, count(DISTINCT word) AS k FROM w JOIN t USING (word), range(0, 2) r(o) WHERE p // stride >= o GROUP BY ALL HAVING k >= need),
best AS (SELECT rid, stride, b, family, min({{'c': -(k / size), 'n': -size, 'l': label}}) AS x FROM held GROUP BY ALL),
more AS (SELECT rid, list(DISTINCT x.l) AS ls, -min(x.c) AS c, count(DISTINCT (stride, b)) AS k FROM best GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(more.ls, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score, coalesce(more.k, 0)::BIGINT AS n_blocks
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""
