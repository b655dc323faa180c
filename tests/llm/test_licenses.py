import random
import re

import duckdb

from beamloom.llm import license_scan as ls
from beamloom.llm.queries import op12_license_scan


def plain(text, templates=ls.TEMPLATES, phrases=ls.PHRASES, threshold=ls.THRESHOLD):
    """All blocks against all templates, without a filter."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    sizes = [len(t.text.replace("-", " ").replace(".", " ").replace(",", " ").replace("/", " ").replace(":", " ").split()) for t in templates]
    notice = max((n for n in sizes if n <= 13), default=0)
    more, score, blocks = set(), 0.0, set()
    for stride in {notice, max(sizes)} - {0}:
        for start in range(0, max(len(ws), 1), stride):
            held, best = set(ws[start : start + 2 * stride]), {}
            for t, n in zip(templates, sizes, strict=True):
                own = {w.decode() for w in ls.words(t.text)}
                need = len(own) if n <= 13 else -(-len(own) * threshold // 1)
                if (n <= 13) == (stride == notice) and len(own & held) >= need:
                    best.setdefault(t.family, []).append((-len(own & held) / len(own), -len(own), t.label))
            for found in best.values():
                c, _, label = min(found)
                more.add(label)
                score = max(score, -c)
                blocks.add((stride, start))
    return (
        len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)),
        1.0 if places else score, len(blocks),
    )


def corpus(seed, n=120):
    """Prose, whole and damaged license texts, and much of one notice."""
    rng = random.Random(seed)
    own = sorted({w.decode() for t in ls.TEMPLATES for w in ls.words(t.text)})
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(["the", "of", "license", "Ünder", "rain", "hat\x00", *own[: rng.choice((1, 120))]]) for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            ws = rng.choice(ls.TEMPLATES).text.split()
            ws = [w for w in ws if rng.random() > rng.choice((0, 0.1, 0.25))]
            parts.insert(rng.randrange(len(parts) + 1), " ".join(ws))
        if i % 3 == 0:
            parts.append("RELEASED under the MIT License. Apache License, Version 2.0; CC BY-NC")
        rows.append((i, "\n".join(parts)))
    return rows


EDGES = [(900, None), (901, ""), (None, "Under the MIT license"), (902, "under the mit license " * 3), (902, "under the mit license " * 3), (903, "---"), (904, "cc by ncx cc byé nc cc by nc")]


def measured(df):
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks")
    return sorted(((str(r.doc_id), *[r[n] for n in names]) for r in df.collect()), key=repr)


def test_against_all_blocks_and_templates(spark):
    rows = corpus(1) + EDGES
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, labels string, blocks string, row int").repartition(6)
    want = sorted(((str(i), *plain(t)) for i, t in rows), key=repr)
    assert measured(ls.license_scan(df)) == want
    assert len({w[6] for w in want}) > 10  # many kinds of labels are found
    assert ls.license_scan(df.limit(0)).count() == 0


def test_sql_gives_the_same(spark):
    rows = corpus(2, 60) + EDGES
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = con.sql(ls.scan_sql("documents"))
    got = sorted(((str(r[0]), *r[1:]) for r in out.fetchall()), key=repr)
    assert got == sorted(((str(i), *plain(t)) for i, t in rows), key=repr)


def test_best_of_a_family():
    assert plain("This work is licensed under the GNU General Public License, version 3.")[5] == "gpl-3"
    assert plain("This work is licensed under the GNU Affero General Public License, version 3.")[5] == "agpl-3"
    assert plain("Released under the BSD License.")[4:7] == ("", "bsd", 1.0)
    assert plain("the license of the rain is under the hat")[5:7] == ("", 0.0)


def test_very_long_text(spark, monkeypatch):
    notice = "This work is licensed under the GNU General Public License, version 3. "
    text = "words " * 400_000 + notice + "élan " * 200_000 + "under the MIT license"
    row = ls.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (600_016, 1, 600_012, "gpl-3,mit")
    monkeypatch.setattr(ls, "PIECE", 7)  # cuts fall between words only
    rank = ls._Ranks({b"license": 0})
    assert ls._ranks("a license, licenselicense élicense (license)", rank).tolist() == [-1, 0, -1, -1, 0]


def test_query_labels_planted_notices(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas().set_index("doc_id").text
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in op12_license_scan(spark, "/root/testdata/sf0.01").collect()}
    said = {"mit": "Released under the MIT License.", "apache-2": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl-3": "GNU General Public License, version 3."}
    assert got == {i: {k for k, v in said.items() if v in (t or "")} for i, t in docs.items()}
