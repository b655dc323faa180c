"""Centroid clustering by plain Lloyd rounds on integers.

Vectors of exactly `dims` components, none null or non-finite, are kept; a component x counts as the
integer floor(scale * x), x as double. The starting centroids are the `k` kept vectors with the
smallest hashes. In each round the centroids (k * dims integers) go out with the task, `mapInPandas`
finds each vector's nearest one (squared Euclidean distance, the smaller number at a tie) and keeps
sums by centroid; a task sends at most k * dims rows, which groupBy merges exactly. The new
centroids are floor(sum / count); one without vectors stays. Rounds end early only where a round
moves nothing, as those after it would move nothing either.

The kept vectors are stored once as integers. What reaches the driver is k vectors at the start,
k * dims sums a round and k inertias at the end, whatever the table's size. A cluster with most of
the vectors costs nothing more, as its sums are made where the vectors are.

Defined results: rows that are not kept (null, of another length, with null or non-finite components)
are not returned; repeated rows are vectors of their own; equal hashes are ordered by components;
a null id is returned as null and, hashing as no number, starts no centroid; fewer than k kept vectors
with an id give fewer centroids, none at all an empty result; further columns are not read. Components
are exact up to 2^53 / scale in size and count as that beyond it; a distance or inertia
above a long's range is given as its largest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm.shared import dropped, returned_memory, written

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Sums are carried in two halves of so many bits, so that none leaves 64 bits in a task.
HALF = 31
LARGEST, BOUND = (1 << 63) - 1, 1 << 53


def quantised(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """vec_id, q (array of long) of the kept rows."""
    v = F.col(vector)
    real = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))))
    return vectors.filter(v.isNotNull() & (F.size(v) == dims) & real).select(F.col(vec_id).alias("vec_id"), whole.alias("q"))


def nearest(q: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of q the number of its nearest centroid and the squared distance, in whole numbers throughout."""
    reach = max(int(np.abs(q).max(initial=0)), max(abs(x) for c in centroids for x in c))
    rows, kind = (q, np.int64) if 4 * reach * reach * q.shape[1] <= LARGEST else (q.astype(object), object)
    distances = np.empty((len(q), len(centroids)), kind)
    for number, centroid in enumerate(centroids):
        d = rows - np.array(centroid, kind)
        distances[:, number] = (d * d).sum(axis=1)
    best = distances.argmin(axis=1)  # the first of equal ones
    return best, distances[np.arange(len(q)), best]


def _sums(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """cluster, place, high, low, n: sums of the components by centroid, in two halves."""
    dims = len(centroids[0])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts = np.zeros((2, len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for frame in frames:
            if len(frame):
                q = np.stack(frame["q"].to_numpy())
                best, _ = nearest(q, centroids)
                for c in np.unique(best):
                    own = q[best == c]
                    total[0, c] += (own >> HALF).sum(axis=0)
                    total[1, c] += (own & ((1 << HALF) - 1)).sum(axis=0)
                    counts[c] += len(own)
        used = np.flatnonzero(counts)
        yield pd.DataFrame(
            {
                "cluster": np.repeat(used, dims), "place": np.tile(np.arange(dims), len(used)), "high": total[0, used].ravel(),
                "low": total[1, used].ravel(), "n": np.repeat(counts[used], dims),
            }
        )

    parts = table.select("q").mapInPandas(returned_memory(run), "cluster int, place int, high long, low long, n long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return parts.groupBy("cluster", "place").agg(wide("high"), wide("low"), F.sum("n").alias("n"))


def _moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    new = [list(c) for c in centroids]
    for r in _sums(table, centroids).collect():  # k * dims rows at most
        new[r["cluster"]][r["place"]] = ((int(r["high"]) << HALF) + int(r["low"])) // r["n"]
    return new


def _assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                best, distance = nearest(np.stack(frame["q"].to_numpy()), centroids)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": best.astype(np.int32), "distance": np.minimum(distance, LARGEST).astype(np.int64)})

    kind = table.schema["vec_id"].dataType
    named = table.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas would take whole numbers with nulls for doubles
    return named.mapInPandas(returned_memory(run), "vec_id string, cluster int, distance long").withColumn("vec_id", F.col("vec_id").cast(kind))


def starts(table: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The components of the k vectors whose ids, behind the seed, have the smallest hashes, in the order of the hashes."""
    hashed = table.filter("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [list(r["q"]) for r in hashed.orderBy("h", "q").limit(k).collect()]


def lloyd(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (module text)."""
    spark = vectors.sparkSession
    table = written(quantised(vectors, vec_id, vector, dims, scale), "quantised")
    centroids = starts(table, k, seed)
    if not centroids:
        nothing = table.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        before, centroids = centroids, _moved(table, centroids)
        if centroids == before:
            break
    assigned = written(_assigned(table, centroids), "assigned")
    dropped(table)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = min(sum(sums.values()), LARGEST)
    rows = [
        (c, min(s, LARGEST), whole, hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()) for c, s in sums.items()
    ]
    digests = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(digests), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def lloyd_sql(vectors: str, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    """The same rounds in SQL."""
    out = [
        f"""q AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS q FROM {vectors}
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1)::INT AS c, q AS m FROM q WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    near = "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM q, c{i}) GROUP BY rid"
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        out.append(
            f"""s{i} AS MATERIALIZED (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY p) AS m FROM (
  SELECT c, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{i} JOIN q USING (rid)) GROUP BY c, p) GROUP BY c)"""
        )
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(s.m, o.m) AS m FROM c{i} o LEFT JOIN s{i} s ON s.c = o.c)")
    out.append(f"a AS MATERIALIZED ({near.format(i=rounds)})")
    return f"""
WITH {', '.join(out)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a JOIN q USING (rid) JOIN c{rounds} USING (c)
"""
