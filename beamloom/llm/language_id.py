"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent n-grams of one to `max_n` letters, blanks
marking word edges. A document goes to the language whose profile is nearest to the document's
own list by out-of-place distance: the sum over the document's n-grams of how far their two
ranks lie apart, or the profile's length for n-grams that the profile lacks.

Profiles are counted over a bounded sample of labelled rows: at most `per_language` documents
of each language, those with the smallest hashes of their ids. From a language's number of
documents follows a hash below which there are some more than that; only such hashes are ranked,
however common the language. The chosen hashes are a written table of known size, so
texts stay where they are while it is small. Every document is predicted from its whole
text in a map without a shuffle; the profiles are languages x `profile` numbers.

Defined results: a text that is null or has no letter gets ``und`` and score 0; ties go to the
language that comes first by name; without any labelled row every document is ``und``;
repeated rows are predicted as often as they occur; a null id is not held out; an empty table
gives an empty result; other columns of the input are not returned, whatever their names; rows whose ids share a hash
are learned from together, so a language may have some more than `per_language`. Only
the id and the text of a row are used for its prediction, and the id for `held_out` alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamloom.llm.shared import written

UNKNOWN = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    if not _FOLD:
        table = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def ngrams(text: str, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text; a code packs up to three letters of 21 bits."""
    letters = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    letters = np.concatenate([[32], letters, [32]]).astype(np.int64)
    blank = letters == 32
    letters = letters[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, parts = letters, [letters[letters != 32]]
    for n in range(2, max_n + 1):
        codes = (codes[:-1] << 21) | letters[n - 1 :]
        parts.append(codes)
    return np.unique(np.concatenate(parts), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def learn_profiles(
    labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 2000, profile: int = 400, max_n: int = 3
) -> dict[str, list[int]]:
    """Language: n-gram codes by falling frequency. At most languages x profile numbers reach the driver."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    slim = known.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"))
    counts = written(slim.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # ten standard deviations more than asked for
    share = (per_language + 10 * per_language**0.5 + 100) / F.col("n")
    low = slim.join(counts, "lang").filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= share).select("lang", "h")
    first = Window.partitionBy("lang").orderBy("h")
    chosen = written(low.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_language).select("lang", "h").distinct(), "chosen")
    sample = known.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text")).join(chosen, ["lang", "h"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums.setdefault(name, []).append(ngrams(value, max_n))
            for name, found in sums.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([k for _, k in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    totals = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = totals.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= profile)
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        profiles.setdefault(row["lang"], []).append(row["code"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], profile: int, max_n: int):
        self.names, self.profile, self.max_n = sorted(profiles), profile, max_n
        self.sorted = []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and how clearly it is nearer than the second: 1/2 (a tie) to 1."""
        mine = top(*ngrams(text or "", self.max_n), self.profile)
        if not len(mine) or not self.names:
            return UNKNOWN, 0.0
        ranks, distances = np.arange(len(mine)), []
        for codes, order in self.sorted:
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            apart = np.where(codes[at] == mine, np.minimum(np.abs(order[at] - ranks), self.profile), self.profile)
            distances.append(int(apart.sum()))
        best = int(np.argmin(distances))
        rest = distances[:best] + distances[best + 1 :]
        second = min(rest) if rest else self.profile * len(mine)
        total = distances[best] + second
        return self.names[best], second / total if total else 0.5


def identify_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 2000, profile: int = 400, max_n: int = 3
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs; learns from rows that are not held out."""
    profiles = learn_profiles(docs.filter(~held_out(F.col(doc_id))), lang, text, doc_id, per_language, profile, max_n)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value, profile, max_n)
        for batch in batches:
            found = [model.predict(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [doc_id, "held_out", "lang_pred", "score"],
            )

    picked = docs.select(F.col(doc_id), held_out(F.col(doc_id)).alias("__held"), F.col(text).cast("string"))
    return picked.mapInArrow(run, f"`{doc_id}` {kind}, held_out boolean, lang_pred string, score double")
