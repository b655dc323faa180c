"""Texts in compressed batches, and the exchange of names between them.

Operators that compare positions of all texts read them from batches of a few megabytes. A
batch sends its distinct 64-bit names to equal slices of the name space (buckets) and gets one
answer for each bucket back, in the order it sent them, so answers need no keys. Batches are
stored bucketed by their number: what is known about a batch goes to it, the texts stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm import packed
from beamloom.llm.shared import returned_memory, written

#: Bytes of text in a batch. Compressed, a batch then stays under half a megabyte: the JVM gives larger objects regions of their own,
#: which keep its heap wide.
BATCH_BYTES = 1_200_000
U = np.uint64


class Batch:
    """A batch of texts, as stored."""

    def __init__(self, blob: bytes, sizes: list[int]):
        raw = zstandard.ZstdDecompressor().decompress(blob)
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(sizes)


def bucket_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """The bucket that Spark puts a 64-bit number into: Murmur3 with seed 42, modulo n."""
    u = numbers.astype(np.int64).view(U)
    h = np.full(len(u), 42, np.uint32)
    for word in ((u & U(0xFFFFFFFF)).astype(np.uint32), (u >> U(32)).astype(np.uint32)):
        k = word * np.uint32(0xCC9E2D51)
        k = ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(0x1B873593)
        h ^= k
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    return h.view(np.int32).astype(np.int64) % n


def _numbers(part: int, n: int) -> Iterator[int]:
    """Numbers of a partition's batches, all of one bucket, so that a task writes one file."""
    for start in range(0, 1 << 32, 4 * n):
        some = (part << 32) + np.arange(start, start + 4 * n)
        yield from some[bucket_of(some, n) == part % n].tolist()


def batches(docs: DataFrame, doc_id: str, text: str, batch_bytes: int) -> DataFrame:
    """(batch, ids, sizes, h1, h2, texts): documents in batches, with 128-bit hashes of the texts."""
    n = packed.buckets(docs)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _numbers(TaskContext.get().partitionId(), n)
        ids, texts, total = [], [], 0

        def close() -> pa.RecordBatch:
            h = [xxhash.xxh3_128_intdigest(t) for t in texts]
            signed = [[(x >> s & packed.MASK) - (1 << 63) for x in h] for s in (0, 64)]
            blob = zstandard.ZstdCompressor(3).compress(b"".join(texts))
            longs = pa.list_(pa.int64())
            arrays = [pa.array([next(numbers)], pa.int64())] + [pa.array([x], longs) for x in (ids, list(map(len, texts)), *signed)] + [pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["batch", "ids", "sizes", "h1", "h2", "texts"])

        for rb in rows:
            for key, value in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                ids.append(key)
                texts.append((value.as_py() or "").encode())
                total += len(texts[-1])
                if total >= batch_bytes or len(ids) >= 100_000:
                    yield close()
                    ids, texts, total = [], [], 0
        if ids:
            yield close()

    picked = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    longs = "array<long>"
    made = picked.mapInArrow(returned_memory(run), f"batch long, ids {longs}, sizes {longs}, h1 {longs}, h2 {longs}, texts binary")
    return written(made, "batches", (n, "batch"))


def copies(batches: DataFrame, least_size: int = 1) -> DataFrame:
    """(batch, copies): hashes of the texts of a batch, of at least so many bytes, that several ids have, and the least such id.
    Equal texts of a batch are one row, so that copies of one text are as many rows as batches hold them."""
    flat = batches.select("batch", F.explode(F.arrays_zip("ids", "sizes", "h1", "h2")).alias("d")).filter(F.col("d.ids").isNotNull() & (F.col("d.sizes") >= least_size))
    each = flat.groupBy("batch", "d.h1", "d.h2").agg(F.min("d.ids").alias("low"), F.max("d.ids").alias("high"))
    each = written(each, "texts")
    first = each.groupBy("h1", "h2").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").drop("most")
    return each.join(first, ["h1", "h2"]).filter("high > least").groupBy("batch").agg(F.collect_list(F.struct("h1", "h2", "least")).alias("copies"))


def twins_of(ids: list, h1: list, h2: list, found: list | None) -> list[tuple[int, int]]:
    """(position, least id) of the documents of a batch whose text a smaller id has."""
    least = {(c["h1"], c["h2"]): c["least"] for c in found or []}
    if not least:
        return []
    firsts = ((k, i, least.get(key)) for k, (i, key) in enumerate(zip(ids, zip(h1, h2, strict=True), strict=True)))
    return [(k, first) for k, i, first in firsts if i is not None and first is not None and first < i]


_COUNT = 5  # bytes of a name that are sent beside its bucket; a filter only


def shortened(keys: np.ndarray) -> np.ndarray:
    return np.frombuffer(keys.astype("<u8").tobytes(), np.uint8).reshape(-1, 8)[:, :_COUNT]


def lengthened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _COUNT, 8), np.uint8)
    out[:, :_COUNT] = np.frombuffer(raw, np.uint8).reshape(-1, _COUNT)
    return out.view("<u8").ravel()


def by_bucket(distinct: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and the edges of their slices of ascending names."""
    bucket = ((distinct >> U(32)) * U(n)) >> U(32)
    edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(distinct)]]) if len(distinct) else np.zeros(1, int)
    return bucket[edges[:-1]].astype(np.int64), edges


def dealt(sent: DataFrame, n: int) -> DataFrame:
    """Rows by bucket, the rows of a bucket one after the other."""
    return sent.repartition(n // 2, "bucket").sortWithinPartitions("bucket")


def grouped(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(first column, the other columns of its rows) of rows sorted by the first column; one bucket is held at a time."""
    key, held = None, []
    for rb in rows:
        firsts = rb.column(0).to_pylist()
        for r, first in enumerate(firsts):
            if first != key:
                if held:
                    yield key, held
                key, held = first, []
            held.append([c[r].as_py() for c in rb.columns[1:]])
    if held:
        yield key, held


def shared_names(sent: DataFrame) -> DataFrame:
    """(batch, bucket, live): a bit for each name sent, set if another document has it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in grouped(rows):
            keys = [lengthened(p[1]) for p in parts]
            several = np.concatenate([np.unpackbits(np.frombuffer(p[2], np.uint8), count=len(k)) for p, k in zip(parts, keys, strict=True)]).astype(bool)
            _, of, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            live = (count > 1)[of] | several
            cuts = np.cumsum([0, *map(len, keys)])
            bits = [np.packbits(live[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([bucket] * len(parts), pa.int64()), pa.array(bits, pa.binary())], ["batch", "bucket", "bits"])

    return sent.mapInArrow(returned_memory(run), "batch long, bucket long, bits binary")


def answered(sent: DataFrame, name: str) -> DataFrame:
    """One row a batch: its answers, as many as there are buckets at most."""
    return sent.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
