import zlib

import numpy as np

from beamloom.llm import language_id
from beamloom.llm.queries import op8_language_id

SF = "/root/testdata/sf0.01"


def test_distance_by_hand():
    def plain(text, n):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        flat, counts = " " + " ".join(words) + " ", {}
        for k in range(1, n + 1):
            for i in range(len(flat) - k + 1):
                if flat[i : i + k] != " ":
                    counts[flat[i : i + k]] = counts.get(flat[i : i + k], 0) + 1
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted((code(g) for g in counts), key=lambda c: (-{code(g): v for g, v in counts.items()}[c], c))

    texts = {"a": "Der Hund und die Katze", "b": "the dog and the cat"}
    profiles = {k: plain(v, 3)[:50] for k, v in texts.items()}
    for k, v in texts.items():
        assert language_id.top(*language_id.ngrams(v, 3), 50).tolist() == profiles[k]
    model = language_id.Classifier(profiles, 50, 3)
    for text in ("the dog, the hat", "und die Hand"):
        mine = plain(text, 3)[:50]
        want = {k: sum(abs(p.index(c) - i) if c in p else 50 for i, c in enumerate(mine)) for k, p in profiles.items()}
        name, score = model.predict(text)
        assert name == min(want, key=want.get) and np.isclose(score, max(want.values()) / sum(want.values()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = op8_language_id(spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(docs.index)
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id])
    test = got[got.held_out & (got.lang_pred != "und")]
    right = test.lang_pred.to_numpy() == docs.loc[test.doc_id].lang.to_numpy()
    assert right.mean() > 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "123 !!", None, 3), (None, "the and of", "en", 4), (8, "der die das und", "de", 5), (8, "der die das und", "de", 5), (6, "und " * 20000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in language_id.identify_languages(df).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (None, "en", False), (6, "de", False)} <= {(a, b, False) for a, b, _ in got}
    assert language_id.identify_languages(df.limit(0)).count() == 0


def test_profiles_against_a_plain_count(spark):
    import collections

    words = ["der", "die", "und", "the", "and", "of", "cat", "Hund", "x1y"]
    rows = [(i, " ".join(words[(i * k) % 9] for k in range(1, 2 + i % 7)), ("de", "en", None)[i % 3]) for i in range(300)] + [(7, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()}
    for per in (20, 2000):
        want = {}
        for lang in ("de", "en"):
            some = sorted((hashes[i], t) for i, t, known in rows if known == lang and t is not None)[:per]
            counts = collections.Counter()
            for _, t in some:
                flat = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
                counts.update(flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1) if flat[i : i + n] != " ")
            code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
            want[lang] = sorted(map(code, counts), key=lambda c, n={code(g): v for g, v in counts.items()}: (-n[c], c))[:60]
        assert language_id.learn_profiles(df, per_language=per, profile=60) == want
