import hashlib
import random

from beamloom.llm.suffix_dedup import suffix_dedup


def brute(rows, length):
    held = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            if i is not None:
                held[b[k : k + length]] = min(i, held.get(b[k : k + length], i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and held[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    r, out = random.Random(seed), []
    words = ["the", "and", "ofth", "é", "ing", "tion", "x", "  "]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(15, 60))) for _ in range(12)]
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6))]
        text = r.choice(["", " ", "\n"]).join(parts)
        if out and r.random() < 0.3:
            text = list(r.choice(out)[1] or "")
            for _ in range(r.choice([0, 0, 1, 3])):
                if text:
                    text[r.randrange(len(text))] = r.choice("abcé")
            text = "".join(text)
        out.append((i * 37 % 1009, text))
    return out


def test_against_brute_force(spark):
    rows = corpus(1, 150) + [(2000, None), (2001, ""), (2002, "a" * 49), (2003, "a" * 50), (2004, "a" * 500), (2005, "ab" * 400), (2006, "ab" * 30), (2007, "ab" * 25)]
    rows += [rows[3], (rows[4][0], rows[7][1] or "z"), (None, rows[10][1]), (None, "ab" * 30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, batch int").repartition(3)
    for size in (4_000_000, 1500):
        got = sorted(map(tuple, suffix_dedup(df, batch_bytes=size).drop("text_hash").collect()), key=str)
        assert got == brute(rows, 50)
    got = suffix_dedup(df, length=30, gram=16, texts=True).collect()
    want = brute(rows, 30)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str) == want
    assert suffix_dedup(df.limit(0)).count() == 0
