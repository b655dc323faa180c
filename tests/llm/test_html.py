import re
import time
import tracemalloc

import pytest

from beamloom.llm import html_extract as h


def test_blocks():
    page = '<body><div class="adBox Main"><p>a &amp; b<br>c <b>d</b>\n e<p>f</div><!-- <p>no</p> --><script>var t="</p>";</script><ul><li>x<li><a href="u">y z</a></ul>tail'
    found = h.blocks(page)
    assert [b[0] for b in found] == ["a & b c d e", "f", "x", "y z", "tail"]
    assert found[0][1].path() == [("body", ()), ("div", ("ad", "box", "main")), ("p", ())] and found[3][1].path()[-2:] == [("ul", ()), ("li", ())]
    assert sorted(h.path_features(found[0][1])) == ["leaf:p", "t:body", "t:div", "t:p", "w:ad", "w:box", "w:main"]
    assert found[3][2] == 1.0 and found[0][2] == 0.0
    assert h.blocks("") == [] and h.blocks("<script>x") == [] and [b[0] for b in h.blocks("a <b")] == ["a <b"]
    assert [b[0] for b in h.blocks('<p title="a>b">q</p><p title="x>r')] == ["q", "r"]


def test_text_inside_math_object_and_noscript_stays():
    page = "<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><object data=f>a figure</object><noscript><p>plain words</p></noscript><svg><text>no</text></svg></article>"
    assert [b[0] for b in h.blocks(page)] == ["let x=2 be", "a figure", "plain words"]


@pytest.mark.parametrize(
    "part", ["<svg ", "<a ", "<a '", '<a "> ', '<a ">" ', "<p>x", "<div>x", "</b>", "</div>", "<!--", "<!", "<script>", "<", "<div class=c{}>x", "<a href='>' b=\"", "<li>x</q>", "&amp", "<svg/>", "<p><b></i>"]
)
def test_hostile_pages_take_linear_time(part):
    model = h.trained()

    def taken(size: int, tail: str) -> float:
        page = "".join(part.replace("{}", str(i)) for i in range(size // len(part))) + tail
        began = time.process_time()
        h.main_text(page, model)
        return time.process_time() - began

    for tail in ("", "'", ">"):  # four times the page: four times the time, and not sixteen
        assert min(taken(400_000, tail) for _ in range(2)) < 8 * max(min(taken(100_000, tail) for _ in range(2)), 0.02)


def test_deep_pages_take_memory_in_proportion():
    tracemalloc.start()
    found = h.blocks("<div class=a>x" * 100_000)
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 100_000 and size < 100e6


def test_whole_texts_of_labelled_pages():
    model, same = h.trained(), 0
    for seed in range(8000, 8200):
        page, main = h.labelled_page(seed)
        want = "\n\n".join(t for t, y in zip([b[0] for b in h.blocks(page)], h.label(page, main)[1], strict=True) if y)
        same += h.main_text(page, model) == want
    assert same >= 180


def test_viterbi_against_all_labellings():
    model = h.trained()
    for seed in range(9000, 9010):
        found = h.blocks(h.labelled_page(seed)[0])[:9]
        scores = model.scores(found)

        def value(y):
            return sum(s for s, v in zip(scores, y, strict=True) if v) + model.start[y[0]] + sum(model.trans[a][b] for a, b in zip(y, y[1:], strict=False))

        best = max(([i >> k & 1 for k in range(len(found))] for i in range(2 ** len(found))), key=value)
        assert abs(value(best) - value(model.decode(found))) < 1e-9


def test_a_notice_is_found_wherever_its_mark_stands():
    text = " ".join(["incomprehensibilities"] * 30) + " cookie"
    assert "notice" in h.text_features(text, 0.0)
    assert "long notice" in h.text_features("word " * 100 + "privacy.", 0.0)


def test_accuracy_on_pages_not_trained_on():
    right = total = 0
    for seed in range(7000, 7300):
        found, labels = h.label(*h.labelled_page(seed))
        right += sum(a == b for a, b in zip(labels, h.trained().decode(found), strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_extract(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = {r.page_id: r.html for r in spark.read.parquet(path).collect()}
    for r in h.extract(spark.read.parquet(path)).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == "\n\n".join(b[0] for b in h.blocks(inside)) and r.n_chars == len(r.text)
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<article><p>one two three four.</p></article>", 3), (4, "u", "<nav><a href=x>a</a></nav>", 4), (4, "u", "<p>" * 20000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text, r.n_chars) for r in h.extract(df).collect()]
    assert got == [(1, "", 0), (2, "", 0), (None, "one two three four.", 19), (4, "", 0), (4, "", 0)]
    assert h.extract(df.limit(0)).count() == 0
