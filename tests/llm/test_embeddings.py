import math

import numpy as np

from beamloom.llm.components import components
from beamloom.llm.embedding_dedup import embedding_links


def brute(rows, threshold=0.98):
    good = {i: (l, np.array(v, float)) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, parent = {i: set() for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(links[i]), find(i)) for i in links}


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 105), (105, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 200: 105, 105: 105, 300: 105}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(60 if c == 0 else 8):
            rows.append((k, [float(x) for x in centre + rng.standard_normal(16) * 0.12], c % 3))
            k += 1
    rows += [(k, rows[5][1], rows[5][2]), (k + 1, rows[5][1], rows[5][2]), (k + 2, rows[5][1], 99)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] * 16, 1), (905, rows[0][1], None), (906, [1.0] * 3, 0), (907, [float("inf")] * 16, 0)]
    want = brute(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    for tile in (1024, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, tile=tile).collect()}
        assert got.keys() == want.keys()
        assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.95 * len(want)
    assert embedding_links(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in embedding_links(null_id).collect()) == [("1", 0, True), ("1", 0, True), ("None", 0, True)]


def test_a_pair_at_the_threshold_links(spark):
    """49 / 50 in plain arithmetic, in either kind of numbers; a last bit below links with nothing."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0], 1), (2, [49.0, 9.0, 3.0, 3.0, 0.0], 1), (3, [3.0, 0.0, 0.0, 0.0, 0.0], 2), (4, [49.0, 9.0, 3.0, 3.0, 1e-6], 2)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(df, tables=200).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_an_id_with_several_vectors_stands_for_all(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_links(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
