"""Exact substring dedup by distributed, sparse prefix doubling.

A byte is removed if a string of `length` bytes covers it that also starts in a document with a
smaller id. As in prefix doubling, a substring of 2L bytes is named by the pair of the names of
its halves at offsets 0 and L; names are 64-bit mixes of such pairs instead of dense ranks, so
every worker names alike without a global renumbering. Positions whose name no other document
has are dropped before the next, longer names are made, until the threshold is passed:

1. Sparse positions: of the names of `GRAM` bytes, each string of `length` bytes holds the
   smallest one (a minimiser), so two equal strings share one, at the same offset. All other
   positions can be left out. The names are sorted across the cluster in equal slices of the
   name space; those found in one document only are unique and drop out.
2. Survivors send the bytes around them (``length`` bytes to either side at most), equal ones of
   a batch once with their smallest id. Sorted by name, each is compared with all others of its
   name at full length, which is past the threshold: for each of the windows of `length` bytes
   around the position, does it occur in a document with a smaller id? Names are then 128 bits.
3. Each document's windows with a smaller holder are laid over it and cut out.

Texts are cut into batches of a few megabytes, compressed, written once to the shared folder
and moved as such; names move packed, a few bytes each. A passage that a third of all documents
hold sends one record a batch. Exact copies of whole texts are found by their hashes first and
need no positions.

Defined results: a null text is an empty one; empty and short texts lose nothing; documents with
a null id lose nothing and give nothing; rows with the same id are no smaller than each other;
an empty table gives an empty result; texts of any length are taken whole; other columns of the
input are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm import packed
from beamloom.llm.shared import returned_memory, written
from beamloom.llm.text_batches import BATCH_BYTES, Batch, answered, batches, by_bucket, copies, dealt, grouped, shared_names, shortened, twins_of

GRAM = 24
U = np.uint64
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], U)
_LAST = U((1 << 64) - 1)


def _pair(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The name of what a and b name together."""
    x = a * U(0x9E3779B97F4A7C15 + 2 * seed) + b
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def names(data: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Names of all runs of `length` along the last axis, by doubling."""
    level, size, done, out = _BYTES[data] ^ U(seed * 0x632BE59BD9B4E019 & packed.MASK), 1, 0, None
    while True:
        if length & size:
            if out is None:
                out, done = level, size
            else:
                n = level.shape[-1] - done
                out, done = (_pair(out[..., :n], level[..., done : done + n], 64 + size), done + size) if n > 0 else (out[..., :0], length)
        if done >= length:
            return out
        if level.shape[-1] <= size:
            return level[..., :0]
        level, size = _pair(level[..., :-size], level[..., size:], size), 2 * size


def _row_names(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of whole rows of bytes."""
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1]
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[i : i + width]) for i in range(0, len(raw), width)]), U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each `width` values in a row."""
    size = 1
    while 2 * size <= width:
        x, size = least(x[:-size], x[size:]), 2 * size
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, names, document numbers) of the minimisers in concatenated texts, some that fit a core's cache at a time."""
    width, step, found, kept = length - gram + 1, 1 << 15, [np.zeros(0, np.int64)], [np.zeros(0, U)]
    edge = np.zeros(width - 1, U)
    for start in range(0, len(data), step):
        lo = max(0, start - width)
        name = names(data[lo : start + step + length], gram)
        if len(name) < width:
            continue
        first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, lo + len(name) + gram)
        for end in (ends[first : last + 1] - lo).tolist():  # no run crosses two texts
            name[max(0, end - gram + 1) : max(0, end)] = _LAST
        least = _slide(name, width, np.minimum)
        at = np.nonzero((name == _slide(np.concatenate([edge, least, edge]), width, np.maximum)) & (name != _LAST))[0]
        at = at[(at >= start - lo) & (at < start - lo + step)]
        found.append(at + lo)
        kept.append(name[at])
    where = np.concatenate(found)
    return where, np.concatenate(kept), np.searchsorted(ends, where, side="right")


def _names_of(batch: Batch, giving: np.ndarray, length: int, gram: int):
    """Anchors of a batch's documents that take part, and their distinct names with a flag for those in two documents."""
    at, name, doc = anchors(batch.data, batch.ends, length, gram)
    use = giving[doc]
    at, name, doc = at[use], name[use], doc[use]
    distinct, of = np.unique(name, return_inverse=True)
    low, high = np.full(len(distinct), len(giving)), np.full(len(distinct), -1)
    np.minimum.at(low, of, doc)
    np.maximum.at(high, of, doc)
    return at, doc, distinct, of, low < high


def _send_names(stored: DataFrame, length: int, gram: int, n: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for r in range(rb.num_rows):
                number, ids, sizes = (rb.column(i)[r].as_py() for i in range(3))
                batch = Batch(rb.column(3)[r].as_py(), sizes)
                *_, distinct, _, several = _names_of(batch, np.array([i is not None for i in ids]), length, gram)
                buckets, edges = by_bucket(distinct, n)
                short = shortened(distinct)
                spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(buckets, pa.int64()), pa.array([number] * len(spans), pa.int64()), pa.array([short[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["bucket", "batch", "names", "several"],
                )

    return dealt(stored.select("batch", "ids", "sizes", "texts").mapInArrow(returned_memory(run), "bucket long, batch long, names binary, several binary"), n)


#: Anchors whose surroundings are held at a time.
SLICE = 1 << 14
#: Pieces (what goes to one bucket) in a stored row.
PIECES = 32


def _alive(distinct: np.ndarray, live: list, n: int) -> np.ndarray:
    """The answered bits of a batch's names."""
    out = np.zeros(len(distinct), bool)
    buckets, edges = by_bucket(distinct, n)
    bits = {r["bucket"]: r["bits"] for r in live}
    for k, b in enumerate(buckets.tolist()):
        out[edges[k] : edges[k + 1]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=edges[k + 1] - edges[k])
    return out


def _survivors(batch: Batch, ids: list, twins: list, live: list, length: int, gram: int, n: int):
    """Positions, document numbers and names of the anchors whose names other documents have, ordered by name, then position; copies take no part."""
    giving = np.array([i is not None for i in ids])
    at, doc, distinct, of, _ = _names_of(batch, giving, length, gram)
    giving[[k for k, _ in twins]] = False
    keep = _alive(distinct, live, n)[of]
    keep &= giving[doc]
    at, doc, of = at[keep], doc[keep], of[keep]
    order = np.argsort(of, kind="stable")
    return at[order], doc[order].astype(np.int32), distinct[of[order]]


def _surroundings(batch: Batch, at: np.ndarray, doc: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Rows of the bytes around some anchors, and the first and past the last valid window; bytes of other texts are
    blanked, so that equal surroundings are equal rows."""
    before = length - gram
    width = length + before
    begin = at - before
    column = np.arange(width)
    around = batch.data[np.clip(begin[:, None] + column, 0, len(batch.data) - 1)]
    starts = np.concatenate([[0], batch.ends[:-1]])
    first = np.maximum(0, starts[doc] - begin)
    last = np.minimum(before, batch.ends[doc] - length - begin)
    around[(column < first[:, None]) | (column >= (last + length)[:, None])] = 0
    return np.concatenate([around, np.stack([first, np.maximum(last + 1, first)], axis=1).astype(np.uint8)], axis=1)


def _stored_records(joined: DataFrame, length: int, gram: int, n: int) -> DataFrame:
    """What a batch sends, PIECES at a time (first: the number of the row's first piece; buckets, around, least), and in a row of its own what it
    needs to read the answers (counts, at, record, smaller). So no row is large, whatever a batch sends.

    Anchors are taken in slices by name; equal surroundings of a slice are one record with their smallest id.
    """

    def sliced(batch: Batch, ids: list, twins: list, live: list) -> list:
        pack = zstandard.ZstdCompressor(1).compress
        at, doc, name = _survivors(batch, ids, twins, live, length, gram, n)
        owner = np.array([0 if i is None else i for i in ids], np.int64)
        sent: list[list] = [[], [], [], []]
        record, smaller, made = np.zeros(len(at), "<i4"), np.zeros(len(at), bool), 0
        for a in range(0, len(at), SLICE):
            part = slice(a, a + SLICE)
            rows = _surroundings(batch, at[part], doc[part], length, gram)
            k1, k2 = _row_names(rows)
            own, called = owner[doc[part]], name[part]
            order = np.lexsort((own, k2, k1, called))
            new = np.ones(len(order), bool)
            new[1:] = (called[order][1:] != called[order][:-1]) | (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            head = order[new]
            least = own[head]
            record[part], smaller[part] = number + made, own > least[number]
            made += len(head)
            buckets, edges = by_bucket(called[head], n)
            whole = rows[head]
            for b, lo, hi in zip(buckets.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for into, x in zip(sent, (b, pack(whole[lo:hi].tobytes()), least[lo:hi].tobytes(), hi - lo), strict=True):
                    into.append(x)
        return [*sent, pack(at.astype("<i4").tobytes()), pack(record.tobytes()), pack(np.packbits(smaller).tobytes())]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [pa.list_(k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.int64())]
        names = ["batch", "first", "buckets", "around", "least", "counts", "at", "record", "smaller"]

        def row(number: int, first: int | None, pieces: list, counts: list | None, rest: list) -> pa.RecordBatch:
            arrays = [pa.array([number], pa.int64()), pa.array([first], pa.int64()), *[pa.array([c], k) for c, k in zip((*pieces, counts), lists, strict=True)]]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array([c], pa.binary()) for c in rest]], names)

        for rb in rows:
            for r in range(rb.num_rows):
                number, ids, sizes, h1, h2, blob, gone, live = (rb.column(i)[r].as_py() for i in range(8))
                *pieces, counts, at, record, smaller = sliced(Batch(blob, sizes), ids, twins_of(ids, h1, h2, gone), live or [])
                yield row(number, None, [None] * 3, counts, [at, record, smaller])
                for a in range(0, len(counts), PIECES):
                    yield row(number, a, [p[a : a + PIECES] for p in pieces], None, [None] * 3)

    cols = joined.select("batch", "ids", "sizes", "h1", "h2", "texts", "copies", "live")
    made = cols.mapInArrow(returned_memory(run), "batch long, first long, buckets array<long>, around array<binary>, least array<binary>, counts array<long>, at binary, record binary, smaller binary")
    return written(made, "records")


def covered_windows(around: np.ndarray, least: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A bit for each window of each record (lowest first): a record of a smaller id has it."""
    before = length - gram
    width = length + before
    n = len(around)
    mask = np.zeros(n, np.uint32)
    if n < 2:
        return mask
    bytes_, lo, hi = around[:, :width], around[:, width].astype(int), around[:, width + 1].astype(int)
    full = ((U(1) << hi.astype(U)) - (U(1) << lo.astype(U))).astype(np.uint32)
    name, _ = _row_names(bytes_[:, before : before + gram])
    order = np.lexsort((least, name))
    edge = np.concatenate([[True], name[order][1:] != name[order][:-1]])
    group = np.cumsum(edge) - 1
    smallest = least[order][edge][group]
    open_ = np.zeros(n, bool)
    open_[order] = least[order] > smallest  # the smallest holder of a name has no smaller one
    # whole surroundings that a smaller id has
    k1, k2 = _row_names(around)
    order2 = np.lexsort((least, k2, k1))
    edge2 = np.ones(n, bool)
    edge2[1:] = (k1[order2][1:] != k1[order2][:-1]) | (k2[order2][1:] != k2[order2][:-1])
    first = least[order2][edge2][np.cumsum(edge2) - 1]
    twice = np.zeros(n, bool)
    twice[order2] = least[order2] > first
    mask[twice] = full[twice]
    open_ &= ~twice
    # the rest: window by window, in the groups that hold open records
    groups = np.zeros(n, np.int64)
    groups[order] = group
    need = np.zeros(group[-1] + 1, bool)
    need[groups[open_]] = True
    rows = np.nonzero(need[groups])[0]
    rows = rows[np.argsort(groups[rows], kind="stable")]
    edges = np.append(np.nonzero(np.diff(groups[rows]))[0] + 1, len(rows))
    start = 0
    while start < len(rows):  # whole groups, some 20,000 records at a time: names of a record's windows take several hundred bytes
        end = int(edges[np.searchsorted(edges, min(start + 20_000, len(rows)))])
        _compare(rows[start:end], np.ascontiguousarray(bytes_[rows[start:end]]), lo, hi, least, length, before, mask)
        start = end
    return mask


def _compare(rows: np.ndarray, around: np.ndarray, lo, hi, least, length: int, before: int, mask: np.ndarray) -> None:
    """Sets the bits of the windows of some records that a smaller id of theirs has, one offset after the other."""
    h1, h2 = names(around, length), names(around, length, 1)
    for o in range(before + 1):
        valid = (lo[rows] <= o) & (o < hi[rows])
        r = rows[valid]
        if len(r) < 2:
            continue
        a, b, ids = h1[valid, o], h2[valid, o], least[r]
        s = np.lexsort((ids, b, a))
        start = np.ones(len(s), bool)
        start[1:] = (a[s][1:] != a[s][:-1]) | (b[s][1:] != b[s][:-1])
        has = np.zeros(len(s), bool)
        has[s] = ids[s] > ids[s][start][np.cumsum(start) - 1]
        mask[r[has]] |= np.uint32(1 << o)


def _answers(sent: DataFrame, length: int, gram: int) -> DataFrame:
    """(batch, piece, masks) for the records sent; a piece is named `bucket` as in other answers."""
    width = 2 * length - gram + 2

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, parts in grouped(rows):
            around = np.concatenate([np.frombuffer(unpack(p[1]), np.uint8).reshape(-1, width) for p in parts])
            masks = covered_windows(around, np.concatenate([np.frombuffer(p[2], "<i8") for p in parts]), length, gram)
            cuts = np.cumsum([0, *[len(p[2]) // 8 for p in parts]])
            blobs = [masks[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[3] for p in parts], pa.int64()), pa.array(blobs, pa.binary())], ["batch", "bucket", "bits"])

    return sent.mapInArrow(returned_memory(run), "batch long, bucket long, bits binary")


def _removed(batch: Batch, twins: list, stored: tuple, answers: list, length: int, gram: int) -> np.ndarray:
    """A flag for each byte of a batch."""
    unpack = zstandard.ZstdDecompressor().decompress
    counts, at, record, smaller = stored
    at, record = np.frombuffer(unpack(at), "<i4").astype(np.int64), np.frombuffer(unpack(record), "<i4")
    bits = {r["bucket"]: r["bits"] for r in answers}
    masks = np.frombuffer(b"".join(bits[piece] for piece in range(len(counts))), "<u4")
    if len(masks) != sum(counts):
        raise ValueError("an answer is missing")
    before = length - gram
    starts = np.concatenate([[0], batch.ends[:-1]])
    doc = np.searchsorted(batch.ends, at, side="right")
    lo, hi = np.maximum(0, starts[doc] - (at - before)), np.minimum(before, batch.ends[doc] - length - (at - before))
    # an equal record of a smaller id in this batch: all windows
    mine = np.where(np.unpackbits(np.frombuffer(unpack(smaller), np.uint8), count=len(at)).astype(bool), np.uint32(0xFFFFFFFF), masks[record] if len(masks) else np.uint32(0))
    begun = np.zeros(len(batch.data) + 1, bool)
    for o in range(before + 1):
        hit = (o <= hi) & (o >= lo) & ((mine >> np.uint32(o)) & 1).astype(bool)
        begun[at[hit] - before + o] = True
    mark = begun.astype(np.int32)
    mark[length:] -= begun[:-length] if len(begun) > length else 0
    gone = np.cumsum(mark[:-1]) > 0
    for c, _ in twins:
        if batch.ends[c] - starts[c] >= length:
            gone[starts[c] : batch.ends[c]] = True
    return gone


def whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """The bytes of a UTF-8 text that are not gone, without what is left of characters that lost some; each kept run is decoded by itself."""
    edges = np.concatenate([[0], np.nonzero(np.diff(gone))[0] + 1, [len(gone)]])
    return b"".join(data[a:b].tobytes().decode(errors="ignore").encode() for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b and not gone[a])


def _cut(joined: DataFrame, length: int, gram: int, texts: bool) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for r in range(rb.num_rows):
                ids, sizes, h1, h2, blob, found, answers, *stored = (c[r].as_py() for c in rb.columns)
                batch = Batch(blob, sizes)
                gone = _removed(batch, twins_of(ids, h1, h2, found), tuple(stored), answers or [], length, gram)
                out: list[list] = [[], [], [], [], []]
                start = 0
                for end in batch.ends.tolist():
                    flags = gone[start:end]
                    kept = batch.data[start:end][~flags].tobytes() if flags.any() else batch.data[start:end].tobytes()
                    spans = int((flags[1:] & ~flags[:-1]).sum() + flags[:1].sum())
                    own = xxhash.xxh64_intdigest(batch.data[start:end].tobytes(), 42)
                    own -= (own >> 63) << 64  # as Spark's xxhash64 of the text
                    for into, x in zip(out, (end - start, end - start - len(kept), spans, whole_characters(batch.data[start:end], flags) if texts else hashlib.sha256(kept).hexdigest(), own), strict=True):
                        into.append(x)
                    start = end
                arrays = [pa.array(ids, pa.int64())] + [pa.array(x, pa.int64()) for x in out[:3]] + [pa.array(out[3], pa.binary() if texts else pa.string()), pa.array(out[4], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts else "kept_sha256", "text_hash"])

    cols = joined.select("ids", "sizes", "h1", "h2", "texts", "copies", "answers", "counts", "at", "record", "smaller")
    return cols.mapInArrow(returned_memory(run), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary" if texts else "kept_sha256 string") + ", text_hash long")


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (or the remaining bytes of whole characters, `kept`) and text_hash (xxhash64 of the text) for each row of docs."""
    if not gram < length <= gram + 31:
        raise ValueError("length must be from gram + 1 to gram + 31: a record's windows are one 32-bit mask")
    n = packed.buckets(docs)
    stored = batches(docs, doc_id, text, batch_bytes)
    live = answered(shared_names(_send_names(stored, length, gram, n)), "live")
    hints = written(live.join(copies(stored, length), "batch", "full"), "hints")
    records = _stored_records(stored.join(hints, "batch", "left"), length, gram, n)
    sent = records.filter("first IS NOT NULL").select("batch", "first", F.posexplode(F.arrays_zip("buckets", "around", "least")).alias("piece", "p"))
    sent = sent.select(F.col("p.buckets").alias("bucket"), "batch", "p.around", "p.least", (F.col("first") + F.col("piece")).alias("piece"))
    answers = answered(_answers(dealt(sent, n), length, gram), "answers")
    read = records.filter("first IS NULL").select("batch", "counts", "at", "record", "smaller").join(answers, "batch", "left").join(hints.select("batch", "copies"), "batch", "left")
    return _cut(stored.join(read, "batch"), length, gram, texts)
