import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from beamloom.llm import byte_bpe, source_mixing
from beamloom.llm.suffix_dedup import whole_characters
from tests.llm.test_jaccard import brute as brute_components


def documents():
    r = random.Random(12)
    word = lambda: r.choice(["the", "and", "of", "to", "in"]) if r.random() < 0.3 else "".join(r.choice(["an", "th", "er", "ing", "é"]) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    out = []
    for i in range(140):
        w = [word() for _ in range(r.choice([3, 40, 80, 150]))]
        if i % 6 == 0:
            w += passage.split()
        text = " ".join(w)
        if out and i % 5 == 0:
            text = r.choice(out)[1] or ""
            if r.random() < 0.5:
                text += " end"
        if i % 17 == 0:
            text = " ".join(w[:7] * 12)
        out.append((i, text, r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3"]), len(text)))
    return out + [(900, None, "en", "s1", 0), (901, "", "en", None, 0), (None, "null id " + out[1][1], "en", "s1", 5)]


def brute_texts(rows, length):
    """What is left of each text: runs of bytes without a string that a smaller id has, without broken characters."""
    held, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            if i is not None:
                held[b[k : k + length]] = min(i, held.get(b[k : k + length], i))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and held[b[k : k + length]] < i:
                gone[k : k + length] = True
        runs, start = [], 0
        for k in range(len(b) + 1):
            if k == len(b) or gone[k]:
                runs.append(b[start:k].decode(errors="ignore"))
                start = k + 1
        out[i] = "".join(runs)
    return out


def base_kept(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(win) if win.count(w) > 1 for k in range(5)}
    return len(words) >= 10 and 100 * len(covered) <= 20 * len(words)


def test_pipeline_against_plain_versions(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in docs.collect()}

    def stage(k, df):
        path = corpus_pipeline.written(corpus_pipeline.STAGES[k][1](spark, df, ""), "test")
        return path

    one = stage(0, docs)
    assert one.columns == docs.columns
    kept = {i for i, r in rows.items() if base_kept(r.text)}
    assert {r.doc_id for r in one.collect()} == kept  # no host fails by half
    two = stage(1, one)
    comp = brute_components([(i, rows[i].text) for i in kept if i is not None], n=5, percent=80)
    kept = {i for i in kept if i is None or comp[i][1] == i}
    assert {r.doc_id for r in two.collect()} == kept and two.columns == docs.columns
    three = stage(2, two)
    want_texts = brute_texts([(i, rows[i].text) for i in kept], 50)
    texts = {r.doc_id: r.text for r in three.collect()}
    assert texts.keys() == kept and three.columns == docs.columns
    assert texts == want_texts
    assert all(r.n_chars == len(r.text) or texts[r.doc_id] == rows[r.doc_id].text for r in three.collect())
    four = stage(3, three)
    want = {r.doc_id for r in source_mixing.mix(three).filter("kept").collect()}
    assert {r.doc_id for r in four.collect()} == want and four.columns == docs.columns
    five = stage(4, four).collect()
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in five} == want
    for r in five:
        assert r.ids == tok.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_replacement_characters_of_a_text_stay_when_it_is_cut(spark):
    shared = "".join(chr(97 + i * i % 26) + str(i) for i in range(40))
    rows = [(1, f"aé{shared}"), (2, f"b\ufffd {shared}\ufffd"), (3, f"c\ufffdè{shared}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "b\ufffd \ufffd", 3: "c\ufffdè"}


def test_characters_do_not_join_over_a_cut():
    data = np.frombuffer("éxè\ufffdy".encode(), np.uint8)
    gone = np.array([0, 1, 1, 1, 0, 0, 0, 0, 0], bool)
    assert whole_characters(data, gone).decode() == "\ufffdy"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
