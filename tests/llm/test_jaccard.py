import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from beamloom.llm import jaccard_join, packed


def brute(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, docs=120):
    r, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(60)]
    for _ in range(docs):
        if out and r.random() < 0.6:
            w = r.choice(out).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        else:
            w = [r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 10, 40, 100, 160]))]
        out.append(" ".join(w))
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.randoms())
def test_linked_sets_share_a_part(tokens, rnd):
    a = set(tokens)
    b = set(a)
    for _ in range(rnd.randint(0, 8)):
        (b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 and len(b) > 1 else b.add(rnd.randrange(2**64)))
    if 100 * len(a & b) >= 90 * len(a | b):
        often = np.array(sorted(rnd.sample(sorted(a | b), rnd.randint(0, len(a)))), np.uint64)
        for percent in (80, 90):
            keys = [set(jaccard_join.part_keys(np.array(sorted(x), np.uint64), percent, often).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_size_classes_meet():
    for percent in (80, 90):
        for a in range(1, 600):
            for b in range(a, a * 100 // percent + 1):
                assert set(jaccard_join._classes(a, percent)) & set(jaccard_join._classes(b, percent)), (a, b)


def test_size_classes_meet_at_low_percent():
    for percent in (30, 50, 60, 79):
        for small in range(1, 120):
            for large in range(small, 100 * small // percent + 1):
                assert set(jaccard_join._classes(small, percent)) & set(jaccard_join._classes(large, percent)), (percent, small, large)
    tokens = np.sort(np.random.default_rng(3).integers(0, 2**63, 100).astype(np.uint64))
    keys = [set(jaccard_join.part_keys(t, 60).tolist()) for t in (tokens, tokens[:60])]
    assert keys[0] & keys[1]


def test_trees_against_all_pairs():
    hashes = packed.WordHashes()
    texts = [t for t in dict.fromkeys(corpus(5, 300)) if t]
    want = brute(list(enumerate(texts)))
    sets = [jaccard_join.shingles((t or "").encode(), 3, hashes) for t in texts]
    for cut in (None, 100):
        links = jaccard_join._cell_links(np.arange(len(sets)), np.zeros(len(sets), int), sets, True, 90)
        if cut:
            a = jaccard_join._cell_links(np.arange(cut), np.zeros(cut, int), sets[:cut], True, 90)
            b = [(x + cut, y + cut) for x, y in jaccard_join._cell_links(np.arange(len(sets) - cut), np.zeros(len(sets) - cut, int), sets[cut:], True, 90)]
            links = a + b + jaccard_join._cell_links(np.arange(len(sets)), (np.arange(len(sets)) >= cut).astype(int), sets, False, 90)
        label = list(range(len(sets)))
        for x, y in links:
            old, new = max(label[x], label[y]), min(label[x], label[y])
            label = [new if v == old else v for v in label]
        assert label == [want[i][1] for i in range(len(sets))]


def test_against_brute_force(spark):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus(1))] + [(2001, None), (2002, ""), (2003, " \n"), (2004, "A b"), (2005, "a B"), (2006, "long " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows] + [(None, "a b", 1, "x"), rows[0] + (1, "x")], "doc_id long, text string, n int, block string")
    want = brute(rows)
    for tile in (2048, 8):
        got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in jaccard_join.jaccard_components(df, tile=tile).collect()]
        assert len(got) == len(rows) + 2
        assert (None, (1, None)) in got
        assert {i: v for i, v in got if i is not None} == want
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join([f"w{i}" for i in range(70)] + [f"w{i}" for i in range(200, 206)])
    rows = [(5, a), (5, b), (9, a + " z"), (7, b + " y"), (5, a), (11, "one two three four"), (12, "one two three four"), (12, "five six seven"), (2, "five six seven")]
    rows += [(None, a), (20, None), (20, "five six seven"), (30, "lone words here")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted({(str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()})
        assert got == sorted({("5", 78, 5), ("5", 74, 5), ("9", 79, 5), ("7", 75, 5), ("11", 2, 2), ("12", 2, 2), ("12", 1, 2), ("2", 1, 2), ("None", 78, None), ("20", 0, 20), ("20", 1, 2), ("30", 1, 30)})


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.randoms())
def test_linked_sets_send_a_common_part_whatever_is_common(tokens, rnd):
    """Levels are any function of the part: of the parts that two linked sets agree on, both send one."""
    a, b = set(tokens), set(tokens)
    for _ in range(rnd.randint(0, 12)):
        (b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 and len(b) > 1 else b.add(rnd.randrange(2**64)))
    if 100 * len(a & b) < 80 * len(a | b):
        return
    sent, found = [], [[jaccard_join._parts(np.array(sorted(x), np.uint64), *s)[::2] for s in jaccard_join._schemes(len(x), 80)] for x in (a, b)]
    both = {int(k) for _, keys in found[0] for k in keys} & {int(k) for _, keys in found[1] for k in keys}
    level_of = {k: rnd.randrange(1, 9) for k in both}
    for x in found:
        keys, scheme = np.concatenate([k for _, k in x]), np.repeat(np.arange(len(x)), [len(k) for _, k in x])
        level = np.array([level_of.get(int(k), rnd.choice([0, 0, 3, 9])) for k in keys], np.uint8)
        sent.append(set(keys[jaccard_join.chosen_parts(level, scheme, np.array([s for s, _ in x]))].tolist()))
    assert sent[0] & sent[1]


def test_texts_with_a_common_passage_are_not_sent_once_for_each_tile(spark, monkeypatch):
    """Long texts that each share two passages with a few others, and near copies of some: what is sent for comparison grows with the texts, not with their square."""
    r, sent = random.Random(9), []
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passages = [text(60) for _ in range(100)]
    docs = [[*text(200), *r.choice(passages), *text(60), *r.choice(passages)] for _ in range(300)]
    docs += [[*d[:50], "x", *d[51:]] for d in docs[:40]]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    links = jaccard_join._block_links
    monkeypatch.setattr(jaccard_join, "_block_links", lambda rows, *a: (sent.append(rows.count()), links(rows, *a))[1])
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, percent=80, tile=16).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i - 300 if i >= 300 else i for i in range(340)}
    assert sent[0] <= 2 * len(docs)
