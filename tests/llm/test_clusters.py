import hashlib
import math

import numpy as np
import pytest

from beamloom.llm import centroids
from beamloom.llm.queries import op11_centroid_clusters

SF = "/root/testdata/sf0.01"


def plain(rows, k=8, rounds=10, dims=64, scale=1024, seed="3"):
    """Lloyd's rounds in Python's whole numbers: sorted (id, cluster, distance, cluster inertia, inertia, hash)."""
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    c = [q for _, q in first]
    if not c:
        return []
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m, strict=True)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, q in kept:
            own[near(q)[1]].append(q)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else m for o, m in zip(own, c, strict=True)]
    out = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = [sum(d for _, n, d in out if n == k) for k in range(len(c))]
    hashes = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    top = (1 << 63) - 1
    return sorted(((str(i), n, min(d, top), min(inertia[n], top), min(sum(inertia), top), hashes[n]) for i, n, d in out))


def got(df):
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((str(r.vec_id), *[r[n] for n in names]) for r in df.collect())


def test_whole_table_against_plain_rounds(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(op11_centroid_clusters(spark, SF)) == plain(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_repeats_and_empty_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i) if i % 11 else None, [float(x) for x in rng.integers(-2, 3, 4) / 2]) for i in range(60)]
    rows += [(7, rows[7][1])] * 20 + [(300 + i, [5.0, 5.0, 5.0, 5.0]) for i in range(40)]  # more than a third in one place
    rows += [(500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 1.0, 1.0]), (504, [1.0, float("nan"), 0.0, 0.0]), (505, [float("-inf")] * 4)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, cluster int, q string, n int").repartition(5)
    for k in (1, 5, 200):
        assert got(centroids.lloyd(df, k=k, dims=4)) == plain(rows, k=k, dims=4)


def test_large_components_and_few_vectors(spark):
    rows = [((1 << 60) + i, [x * 1e6, -x * 3e8, 0.1, x]) for i, x in enumerate((1.0, -2.5, 1.25, 1e3, -7.0))] + [(None, [9.0, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(centroids.lloyd(df, k=3, dims=4)) == plain(rows, k=3, dims=4)
    one = df.limit(0).unionAll(spark.createDataFrame([(4, [1e300] * 4)], df.schema))
    assert got(centroids.lloyd(one, dims=4))[0][:3] == ("4", 0, 0)


def test_nothing_to_cluster(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    for empty in (df, df.limit(0)):
        out = centroids.lloyd(empty)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    only_null = spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert centroids.lloyd(only_null, dims=2).count() == 0  # no start, so no cluster


def test_rounds_end_early_only_at_rest(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rounds in (0, 1, 3, 100):
        assert got(centroids.lloyd(df, k=4, dims=3, rounds=rounds)) == plain(rows, k=4, dims=3, rounds=rounds)
