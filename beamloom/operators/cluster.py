"""Spatial clustering: 8-connected pixels of one detector and event.

Pixels are dealt by (event, detector) and labelled a partition at a time: neighbours are found by
binary search in the sorted pixel keys of all groups at once, and labels spread over the links
with pointer jumping. Work is in proportion to the pixels, for groups of any shape; a group
that runs over an Arrow batch is held until it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("event_id", "detector")


def last_hits(hits: DataFrame) -> DataFrame:
    """One hit a pixel and event: the last in time; equal times by charge, then channel."""
    best = F.max_by(F.struct("charge", "ts", "channel"), F.struct("ts", "charge", "channel")).alias("h")
    return hits.groupBy(*KEY, "col", "row").agg(best).select(*KEY, "col", "row", "h.charge", "h.ts", "h.channel")


def discard_incomplete(hits: DataFrame, required: list[str]) -> DataFrame:
    """Hits of events in which each required detector has hits."""
    full = hits.filter(F.col("detector").isin(required)).groupBy("event_id").agg(F.count_distinct("detector").alias("k")).filter(F.col("k") == len(set(required)))
    return hits.join(full.select("event_id"), "event_id", "left_semi")


def _labels(group: np.ndarray, col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For pixels sorted by (group, col, row): the index of the first pixel of each one's component."""
    n = len(col)
    height = int(row.max()) + 3
    width = int(col.max()) + 3
    key = (group * width + col + 1) * height + row + 1
    label = np.arange(n)
    u, v = [], []
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        want = key + dx * height + dy
        at = np.minimum(np.searchsorted(key, want), n - 1)
        hit = np.nonzero(key[at] == want)[0]
        u.append(hit)
        v.append(at[hit])
    a, b = np.concatenate(u), np.concatenate(v)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def label(pixels: DataFrame, die: str | None = None) -> DataFrame:
    """pixels with seed_col and seed_row: the first pixel, by col and row, of each one's cluster; with `die`, none crosses dies.

    pixels has one row a (event_id, detector, col, row), cols and rows from 0.
    """
    parts = [*KEY, *([die] if die else [])]
    first = pixels.withColumn("__g", F.xxhash64(*parts))
    dealt = first.repartition(*KEY).sortWithinPartitions("__g", *parts, "col", "row")
    schema = dealt.drop("__g").schema.add("seed_col", T.IntegerType()).add("seed_row", T.IntegerType())
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def close(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            keys = [t.column(c).combine_chunks() for c in ("__g", *parts)]
            new = np.zeros(t.num_rows, bool)
            for k in keys:
                k = k.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(k.type) else k.to_numpy(zero_copy_only=False)
                new[1:] |= k[1:] != k[:-1]
            group, col, row = np.cumsum(new), t.column("col").to_numpy().astype(np.int64), t.column("row").to_numpy().astype(np.int64)
            seed = _labels(group, col, row)
            t = t.drop_columns(["__g"]).append_column("seed_col", pa.array(col[seed], pa.int32())).append_column("seed_row", pa.array(row[seed], pa.int32()))
            yield from t.select(names).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows:
                g = held.column("__g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from close(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from close(held)

    return dealt.mapInArrow(run, schema)


CLUSTER = (*KEY, "seed_col", "seed_row")


def clusters(labelled: DataFrame, weighted: bool = True) -> DataFrame:
    """One row a cluster: charge, weighted centre and time, size, widths, and the seed's charge and channel (most charge, then first)."""
    w = F.col("charge") if weighted else F.lit(1.0)
    mean = lambda c: (F.sum(w * F.col(c)) / F.nullif(F.sum(w), F.lit(0.0)))
    seed = F.max_by(F.struct("charge", "channel"), F.struct(F.col("charge"), -F.col("col"), -F.col("row")))
    return labelled.groupBy(*CLUSTER).agg(
        F.sum("charge").alias("charge"), mean("col").alias("col"), mean("row").alias("row"), mean("ts").alias("ts"), F.min("ts").alias("first_ts"), F.count("*").alias("size"),
        (F.max("col") - F.min("col") + 1).alias("width_col"), (F.max("row") - F.min("row") + 1).alias("width_row"), seed.alias("s"),
    ).select(*CLUSTER, "charge", "col", "row", "ts", "first_ts", "size", "width_col", "width_row", F.col("s.charge").alias("seed_charge"), F.col("s.channel").alias("channel"))


def multiplicity(clusters_: DataFrame) -> DataFrame:
    """detector, clusters (in an event), events: events without pixels in the detector are not counted."""
    return clusters_.groupBy(*KEY).agg(F.count("*").alias("clusters")).groupBy("detector", "clusters").agg(F.count("*").alias("events"))


def replace_detector(clusters_: DataFrame, new: DataFrame, detector: str) -> DataFrame:
    return clusters_.filter(F.col("detector") != detector).unionByName(new)
