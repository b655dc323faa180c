"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

Equal vectors of one label form a class with one representative, so a group of copies costs one
row. Each representative has a sign code in each of several tables; only (code, id) rows are
shuffled to find the codes that several have, and vectors go to these alone. Vectors that share a
code and a label are compared by exact cosines in double precision, in tiles of bounded size: a
bucket of n vectors is split into ceil(n / tile) tiles and each pair of tiles is one group, so no
bucket is capped and none lands in one task. A pair that meets in several tables counts in the
first only. Groups return link counts and a spanning forest, never the pairs.

The chance that a pair at cosine c meets is 1 - (1 - (1 - acos(c)/pi)^bits)^tables: 0.998 at
c = 0.98 with the defaults, more above.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components,
vectors with a null label and rows with a null id link with nothing. Vectors of different
lengths do not link. Rows with the same id and vector are one vector and each is returned. An id
with several vectors stands for all of them: classes led by the same id share their links and their
component. A cosine of exactly the threshold links. An empty table gives an empty result. Other
columns of the input, whatever their names, are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm.components import components
from beamloom.llm.shared import written


def _coded(reps: DataFrame, bits: int, tables: int, seed: int, kind: str) -> DataFrame:
    """reps with `codes`: one unsigned 32-bit sign code for each table, `vec` as raw numbers of a kind, and `keys`, hashes of (table, code, label, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = (1 << np.arange(bits)).astype(np.uint32)
        for batch in batches:
            vecs = [np.array(v, np.float64) for v in batch.column("vec").to_pylist()]
            codes: list[bytes] = [b""] * len(vecs)
            for dim in {len(v) for v in vecs}:
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                at = [i for i, v in enumerate(vecs) if len(v) == dim]
                signs = (np.stack([vecs[i] for i in at]) @ planes[dim] >= 0).reshape(len(at), tables, bits)
                for i, row in zip(at, (signs * powers).sum(axis=2, dtype=np.uint32), strict=True):
                    codes[i] = row.astype("<u4").tobytes()
            keys = []
            for v, label, c in zip(vecs, batch.column("label").to_pylist(), codes, strict=True):
                tail = f":{len(v)}:{label}".encode()
                keys.append([xxhash.xxh64_intdigest(c[4 * t : 4 * t + 4] + bytes([t % 256, t // 256]) + tail) - (1 << 63) for t in range(tables)])
            raw = [v.astype(kind).tobytes() for v in vecs]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("rep", "label", "k1", "k2", "n")], pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["rep", "label", "k1", "k2", "n", "vec", "codes", "keys"],
            )

    return reps.mapInArrow(run, "rep long, label string, k1 long, k2 long, n long, vec binary, codes binary, keys array<long>")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b) / (float(a @ a) ** 0.5 * float(b @ b) ** 0.5)


def _links_of_group(t: int, same_tile: bool, tile: np.ndarray, rep, weight, label, vec, codes, threshold: float, kind: str):
    """(rep, counted weight of partners, a link or None) of the members of one group of tiles."""
    by_kind: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(label, map(len, vec), strict=True)):
        by_kind.setdefault(key, []).append(k)
    for members in by_kind.values():
        if len(members) < 2:
            continue
        at = np.array(members)
        x = np.stack([np.frombuffer(vec[k], kind).astype(np.float64) for k in members])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        c = np.stack([np.frombuffer(codes[k], "<u4") for k in members])
        cosine = np.triu(unit @ unit.T, 1)
        for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-12), strict=True):  # roundings of the unit vectors do not decide
            cosine[i, j] = _cosine(x[i], x[j])
        near = np.triu(cosine >= threshold, 1) & (c[:, None, t] == c[None, :, t])
        i, j = np.nonzero(near)
        if not same_tile:
            cross = tile[at[i]] != tile[at[j]]
            i, j = i[cross], j[cross]
        first = np.ones(len(i), bool)
        for earlier in range(t):
            first &= c[i, earlier] != c[j, earlier]
        i, j = i[first], j[first]
        if not len(i):
            continue
        w, ids = weight[at], rep[at]
        total = np.bincount(i, w[j], len(at)) + np.bincount(j, w[i], len(at))
        root = _forest(len(at), i, j)
        for k in np.nonzero(total)[0]:
            yield int(ids[k]), int(total[k]), int(ids[root[k]]) if root[k] != k else None


def _grouped_links(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Runs over rows sorted by (key, t, a, b); a group is as large as two tiles at most."""
    keys = ("key", "t", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def close(part: pa.Table) -> pa.RecordBatch:
            out = []
            heads = np.stack([part.column(k).to_numpy() for k in keys], axis=1)
            edges = np.concatenate([[0], np.nonzero((heads[1:] != heads[:-1]).any(axis=1))[0] + 1, [len(heads)]])
            tile, rep, n = (part.column(k).to_numpy() for k in ("tile", "rep", "n"))
            label, vec, codes = (part.column(k).to_pylist() for k in ("label", "vec", "codes"))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    _, t, a, b = heads[lo]
                    out += _links_of_group(int(t), a == b, tile[lo:hi], rep[lo:hi], n[lo:hi], label[lo:hi], vec[lo:hi], codes[lo:hi], threshold, kind)
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rep", "links", "other"])

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            heads = np.stack([held.column(k).to_numpy() for k in keys], axis=1)
            open_from = len(heads) - int(np.argmax((heads[::-1] != heads[-1]).any(axis=1))) if (heads != heads[-1]).any() else 0
            if open_from:
                yield close(held.slice(0, open_from))
                held = held.slice(open_from).combine_chunks()
        if held is not None and held.num_rows:
            yield close(held)

    return rows.mapInArrow(run, "rep long, links long, other long")


def embedding_links(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98,
    bits: int = 20, tables: int = 20, seed: int = 11, tile: int = 1024,
) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept (see the module's text)."""
    small = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if small else "<f8"  # floats are exact doubles
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if small else "array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vec", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad
    good = rows.filter(usable).withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    same = ["label", "k1", "k2"]
    ids = good.select(*same, "vec_id").distinct().groupBy(*same).agg(F.count("*").alias("n"))
    classes = good.groupBy(*same).agg(F.min("vec_id").cast("long").alias("rep"), F.any_value("vec").alias("vec")).join(ids, same)
    coded = written(_coded(classes, bits, tables, seed, kind), "codes")
    exploded = coded.select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = exploded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    met = (
        exploded.join(sizes, "key")
        .withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .withColumns({"a": F.least("tile", "with"), "b": F.greatest("tile", "with")})
        .select("key", "t", "a", "b", "tile", "rep")
    )
    dealt = written(met, "met").join(coded.drop("keys", "k1", "k2"), "rep").select("key", "t", "a", "b", "tile", "rep", "n", "label", "vec", "codes")
    dealt = dealt.repartition("key", "t", "a", "b").sortWithinPartitions("key", "t", "a", "b")
    found = written(_grouped_links(dealt, threshold, kind), "links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.filter("other IS NOT NULL"), "rep", "other").withColumnRenamed("node", "rep")
    per_class = coded.select("label", "k1", "k2", "rep", "n").join(totals, "rep", "left").join(comps, "rep", "left")
    per_class = per_class.select(
        F.col("label").alias("__l"), F.col("k1").alias("__1"), F.col("k2").alias("__2"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"),
    )
    keyed = rows.withColumns({"k1": F.when(usable, F.xxhash64("vec")), "k2": F.when(usable, F.xxhash64(F.lit(1), "vec"))}).drop("vec")
    joined = keyed.join(per_class, (F.col("label") == F.col("__l")) & (F.col("k1") == F.col("__1")) & (F.col("k2") == F.col("__2")), "left")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
