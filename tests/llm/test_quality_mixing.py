import re

import pytest

from beamloom.llm import quality_rules, source_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c d e", "a b c d e f a b c d e f", "x " * 50, "é🙂 ñ\x0bb\x0cc\rd", "l1\nl1\n\nl1 \nl2", "##$$ <a> | b & c%", "one two three four five six seven eight nine ten", "w " * 3000 + "z", "a b c d e\x85f"]


def test_measures(spark):
    rows = [(i, t, f"h{i % 2}", 7) for i, t in enumerate(TEXTS)] + [(None, TEXTS[9], None, 7), (9, TEXTS[9], "h1", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, N_WORDS int")
    got = quality_rules.quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[9] if r.doc_id is None else TEXTS[r.doc_id]
        want = measures(text)
        assert (r["n_words"], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)
    assert next(r for r in got if r.doc_id is None).kept
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_host_verdicts(spark):
    good, bad = "one two three four five six seven eight nine ten", "short"
    rows = [(h * 1000 + i, bad if i < (190 if h == 0 else 10) else good, f"h{h}") for h in range(6) for i in range(200)] + [(9000, good, "tiny"), (9001, bad, "tiny"), (9002, bad, None), (9003, good, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[199].host_rejected and not got[199].kept and not got[1199].host_rejected and got[1199].kept
    assert got[9000].kept and got[9003].kept and not got[9002].host_rejected


def test_raking_meets_the_marginals(spark):
    rows = [(s, l, t, n) for s, l, t, n in [("a", "en", "prose", 1000), ("a", "de", "prose", 100), ("b", "en", "table", 50), ("b", "de", "prose", 500), ("c", "en", "prose", 10), ("c", "de", "table", 900), ("a", "en", "table", 30), ("c", "en", "table", 5)]]
    cells = spark.createDataFrame(rows, "__source string, __lang string, __topic string, __n long")
    targets = ({"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.6, "de": 0.4}, {"table": 0.25})
    got = source_mixing.raked(cells, targets, 40).collect()
    for dim, target in zip(source_mixing.DIMS, targets, strict=True):
        for name, share in target.items():
            assert sum(r["__w"] for r in got if r[dim] == name) == pytest.approx(share, abs=1e-4)


def test_mix_edges(spark):
    rows = [(i, "word " * (5 + i % 40), f"s{i % 3}", "en" if i % 4 else None, 1) for i in range(400)] + [(None, None, None, None, 1), (1000, "", "s9", "xx", 1), (1000, "", "s9", "xx", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    got = source_mixing.mix(df, fraction=0.5, rounds=4).collect()
    assert len(got) == len(rows) and all(0 <= r.prob <= 1 for r in got)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.prob for r in got) == pytest.approx(0.5 * total, rel=0.02)
    assert sum(r.tokens for r in got if r.kept) == pytest.approx(0.5 * total, rel=0.2)
    assert len({r.kept for r in got if r.doc_id == 1000}) == 1
    assert source_mixing.mix(df.limit(0)).count() == 0


def test_both_ways_to_rake_agree(spark, monkeypatch):
    rows = [(i, "word " * (i % 90) + ("licence" if i % 7 == 0 else ""), f"s{i % 23}" if i % 5 else None, ("en", "de", "fr", None)[i * i % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for rounds, again in ((0, 0), (1, 1), (12, 8)):
        both = []
        for cells in (512, 0):
            monkeypatch.setattr(source_mixing, "CELLS", cells)
            both.append(sorted(tuple(r) for r in source_mixing.mix(df, keep_text=False, rounds=rounds, calibration_rounds=again).select("doc_id", "rate", "prob", "kept").collect()))
        for a, b in zip(*both, strict=True):
            assert a[::3] == b[::3] and a[1:3] == pytest.approx(b[1:3], abs=2e-6)


def test_very_long_texts(spark):
    long = "a b c d e f " * 60_000 + "licence"
    df = spark.createDataFrame([(1, long, "s", "en"), (2, "few words of prose here", "s", "en")], "doc_id long, text string, source string, lang string")
    row = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}[1]
    assert row["n_words"] == 360_001 and row.n_repeat_words == 360_000 and row.base_failed
    got = {r.doc_id: r for r in source_mixing.mix(df).collect()}
    assert got[1].tokens == 360_001 and got[1].topic == "licence" and got[2].topic == "prose"


def test_marginals_of_a_mixture(spark):
    rows = [(i, "word " * 40, f"s{i % 3}", ("en", "de")[i % 7 == 0]) for i in range(3000)] + [(9001, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = ({"s0": 0.3, "s1": 0.3}, {"en": 0.8, "de": 0.2}, {})
    report = {(r.dimension, r["class"]): r for r in source_mixing.marginals(source_mixing.mix(df, targets=targets, fraction=0.4), targets).collect()}
    assert report.keys() == {("source", "s0"), ("source", "s1"), ("source", "s2"), ("source", "(none)"), ("lang", "en"), ("lang", "de"), ("lang", "(none)"), ("topic", "prose")}
    for r in report.values():
        assert r.expected == pytest.approx(r.aim, abs=1e-4) and r.kept == pytest.approx(r.aim, abs=0.06)
    assert report[("source", "s2")].aim == pytest.approx(0.4) and report[("lang", "de")].aim == pytest.approx(0.2)
