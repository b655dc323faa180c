"""Exact Jaccard join of word n-gram sets by signature trees, with connected components.

1. Equal sets form a class, which has a number and is represented by one of its documents; an id with several texts links
   their classes.
2. Routing, the upper levels of the forest: the token space is cut into so many parts that two
   linked sets must agree on at least one part wholly (they differ in at most (a+b)/19 tokens
   at 0.9, and one token spoils one part). Representatives that share a part are put into one
   block; blocks are closed under sharing, so no link crosses two blocks.
3. In a block a binary tree is built over the sets: a node holds the OR of its sets' token
   bitmaps and their size range. Two trees are traversed together; a pair of nodes is dropped
   when the largest overlap that its bitmaps and sizes allow is too small for the threshold, or
   when its documents are already in one component. Pairs of documents that remain are
   compared exactly. Blocks beyond `tile` sets are cut into tiles and each pair of tiles, in large
   blocks each of sizes near one another, is a task of its own, so no set is left out and no task
   is unbounded.
4. The links found (a spanning forest) give the components, named by the smallest id of their classes.

Defined results: a null, empty or blank text has no n-grams, links with nothing and is its own
component; texts with fewer words than n have their whole word sequence as one n-gram; rows
with a null id have no component and link with nothing; repeated rows of an id are one
document and each is returned, with the size of its own text's set: what links with one of an id's texts links with the id; an empty table gives an empty result; other columns of the
input are not returned. Words are parted by ASCII white space and only A-Z are lower-cased.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm import packed
from beamloom.llm.components import components
from beamloom.llm.shared import compact, dropped, returned_memory, written
from beamloom.llm.text_batches import BATCH_BYTES, Batch, answered, batches, by_bucket, dealt, grouped, lengthened, shortened

#: Sizes of a class of the routing scheme span this ratio.
RATIO = 1.25
LEAF = 32
#: Blocks of more tiles have bands of sizes; tiles of a band at most.
BANDED, TILES = 3, 1 << 20
MAX_BITS = 1 << 15
#: Documents of a task that are counted together to find frequent tokens.
COUNTED_DOCS = 3000
#: Weight of a token that is not frequent: a token of half as many documents weighs 4 more.
RARE = 64
#: Tokens that count as frequent at most, the most frequent ones; they steer the routing only, any choice gives the same links.
FREQUENT = 200_000


def shingles(text: bytes, n: int, hashes: packed.WordHashes) -> np.ndarray:
    """The set of a text's n-grams as ascending 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(packed.rolled(h, n)) if len(words) >= n else packed.rolled(h, len(words)) ^ np.uint64(len(words))


def _class_start(c: int) -> int:
    """First size of class c."""
    return 1 if c == 0 else int(np.ceil(RATIO ** (c + 2)))


def _classes(n: int, percent: int) -> list[int]:
    """Schemes in which a set of n tokens takes part: its own class, and all those above that larger partners reach into."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    c = 0
    while _class_start(c + 1) <= n:
        c += 1
    out = [c]
    while 100 * n >= percent * _class_start(out[-1] + 1):
        out.append(out[-1] + 1)
    return out


def _scheme_keys(tokens: np.ndarray, weight: np.ndarray, differ: int, prefix: np.uint64) -> np.ndarray:
    """Keys of the parts of a set under the scheme for sets that differ in at most `differ` tokens.

    With `spare` parts more than differ + 1, linked sets agree on spare + 1 parts or more. So each
    set may leave out its parts below weight t, where at most `spare` of its parts are: for the
    larger t of two sets, at least one of the parts that they agree on reaches it, and both send it.
    Any weight that follows from a part's tokens would do. This one, the sum of its tokens' weights,
    leaves out what says least: empty parts, then frequent tokens, then a rare one alone, which
    would put all texts with one common passage into a block that grows with the corpus.
    """
    spare, part, keys = _parts(tokens, differ, prefix)
    heavy = np.bincount(part, weight, len(keys)).astype(np.int64)
    return keys[heavy >= np.partition(heavy, spare)[spare]]


def _parts(tokens: np.ndarray, differ: int, prefix: np.uint64) -> tuple[int, np.ndarray, np.ndarray]:
    """How many parts a set may leave out, the part of each token, and the keys of all parts."""
    spare = (differ + 1) // 2
    parts = differ + 1 + spare
    spread = packed.mix(tokens)
    part = (((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, part, packed.mix(spread ^ np.uint64(0x5851F42D4C957F2D)))
    return spare, part, packed.mix(sums ^ packed.mix(np.arange(1, parts + 1, dtype=np.uint64) ^ prefix))


def _schemes(n: int, percent: int) -> Iterator[tuple[int, np.uint64]]:
    """For each scheme of a set of n tokens: in how many tokens two linked sets of it differ at most, and the prefix of its keys."""
    for c in _classes(n, percent):
        # sets up to the largest size differ in at most 2 * largest * (100 - percent) / (100 + percent) tokens
        yield 2 * (_class_start(c + 1) - 1) * (100 - percent) // (100 + percent), packed.mix(np.array([c + 1], np.uint64))[0]


def part_keys(tokens: np.ndarray, percent: int, frequent: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """Keys of the parts of a set: equal keys are equal parts of one scheme. `frequent`: ascending tokens with `weights` (none: 0), under
    RARE; others weigh RARE."""
    out = []
    weight = np.full(len(tokens), RARE, np.int64)
    if frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, 0 if weights is None else weights[at], weight)
    for differ, prefix in _schemes(len(tokens), percent):
        out.append(_scheme_keys(tokens, weight, differ, prefix))
    return np.concatenate(out)


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT most common of the tokens that a thousandth of all documents or more have, ascending, and their weights, the less the
    more documents have them; batches name those frequent in them."""
    total = described.count()
    sums = described.select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.n").alias("n")).filter(F.col("n") >= max(8, total // 1000))
    found = sums.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens, n = np.array([r["token"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(tokens)
    return tokens[order], np.clip(1 + 4 * np.log2(total / np.maximum(n[order], 1)), 1, RARE - 1).astype(np.int64)


class Tree:
    """A binary tree over sets in an order that puts like ones together; leaves hold up to LEAF sets."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = packed.mix(s) & np.uint64(bits - 1)
            np.bitwise_or.at(self.maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        #: Tokens of a set beyond its bits.
        self.excess = self.size - np.bitwise_count(self.maps).sum(axis=1)
        self.nodes: list[tuple] = []
        self.build(0, len(sets))

    def build(self, lo: int, hi: int) -> int:
        """Returns the number of the node: (lo, hi, OR, smallest size, largest size, least excess bound, children)."""
        if hi - lo <= LEAF:
            ored, kids = np.bitwise_or.reduce(self.maps[lo:hi], axis=0), None
        else:
            mid = (lo + hi) // 2
            kids = (self.build(lo, mid), self.build(mid, hi))
            ored = self.nodes[kids[0]][2] | self.nodes[kids[1]][2]
        self.nodes.append((lo, hi, ored, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), int(self.excess[lo:hi].max()), kids))
        return len(self.nodes) - 1


def _linked(overlap, a, b, percent: int):
    return (100 + percent) * overlap >= percent * (a + b)


def tree_links(a: Tree, b: Tree | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a tree (b None), or between two; sets of b are numbered after a's."""
    other, shift = b or a, len(a.sets) if b else 0
    label = np.arange(len(a.sets) + (len(b.sets) if b else 0))
    links: list[tuple[int, int]] = []
    stack = [(len(a.nodes) - 1, len(other.nodes) - 1)]
    while stack:
        p, q = stack.pop()
        lo1, hi1, or1, min1, max1, ex1, kids1 = a.nodes[p]
        lo2, hi2, or2, min2, max2, ex2, kids2 = other.nodes[q]
        if b is not None or p != q:
            if 100 * min(max1, max2) < percent * max(min1, min2):
                continue
            most = min(max1, max2, int(np.bitwise_count(or1 & or2).sum()) + min(ex1, ex2))
            if not _linked(most, min1, min2, percent):
                continue
        l1, l2 = label[lo1:hi1], label[shift + lo2 : shift + hi2]
        if l1[0] == l2[0] and (l1 == l1[0]).all() and (l2 == l2[0]).all():
            continue
        if kids1 or kids2:
            left = kids1 if kids1 and (not kids2 or hi1 - lo1 >= hi2 - lo2) else None
            if b is None and p == q:
                stack += [(kids1[0], kids1[0]), (kids1[1], kids1[1]), (kids1[0], kids1[1])]
            elif left:
                stack += [(left[0], q), (left[1], q)]
            else:
                stack += [(p, kids2[0]), (p, kids2[1])]
            continue
        common = np.bitwise_count(a.maps[lo1:hi1, None] & other.maps[None, lo2:hi2]).sum(axis=2) + np.minimum(a.excess[lo1:hi1, None], other.excess[None, lo2:hi2])
        s1, s2 = a.size[lo1:hi1, None], other.size[None, lo2:hi2]
        may = _linked(np.minimum(common, np.minimum(s1, s2)), s1, s2, percent)
        if b is None and p == q:
            may &= np.triu(np.ones(may.shape, bool), 1)
        for i, j in zip(*np.nonzero(may), strict=True):
            x, y = lo1 + i, shift + lo2 + j
            if label[x] == label[y]:
                continue
            u, v = a.sets[lo1 + i], other.sets[lo2 + j]
            overlap = len(u) + len(v) - len(np.union1d(u, v))
            if _linked(overlap, len(u), len(v), percent):
                links.append((int(x), int(y)))
                old, new = label[y], label[x]
                label[label == old] = new
    return links


def _cell_links(ids: np.ndarray, tile: np.ndarray, sets: list[np.ndarray], same_tile: bool, percent: int) -> list[tuple[int, int]]:
    # the smallest token groups near copies, the size sorts them
    order = sorted(range(len(ids)), key=lambda i: (tile[i], int(sets[i][0]), len(sets[i])))
    bits = min(MAX_BITS, 1 << max(8, int(32 * max(map(len, sets)) - 1).bit_length()))
    if same_tile:
        return [(int(ids[order[x]]), int(ids[order[y]])) for x, y in tree_links(Tree([sets[i] for i in order], bits), None, percent)]
    cut = sum(tile[i] == tile[order[0]] for i in order)
    if cut == len(order):
        return []
    found = tree_links(Tree([sets[i] for i in order[:cut]], bits), Tree([sets[i] for i in order[cut:]], bits), percent)
    return [(int(ids[order[x]]), int(ids[order[y]])) for x, y in found]


def _block_links(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Runs over rows sorted by (block, a, b); a group has at most about two tiles of sets. Texts come compressed, a third of
    the bytes of their sets, which are made here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        hashes, unpack = packed.WordHashes(), zstandard.ZstdDecompressor().decompress

        def close() -> pa.RecordBatch:
            found = _cell_links(np.array(list(held)), np.array([r[0] for r in held.values()]), [r[1] for r in held.values()], key[1] == key[2], percent) if len(held) > 1 else []
            u, v = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("block", "a", "b", "node", "tile")]
            for block, a, b, doc, tile, text in zip(*cols, (x.as_py() for x in batch.column("text")), strict=True):
                if key != (block, a, b):
                    if held:
                        yield close()
                    key, held = (block, a, b), {}
                held[doc] = (tile, shingles(unpack(text), n, hashes))
        if held:
            yield close()

    return rows.mapInArrow(returned_memory(run), "u long, v long")


def _described(stored: DataFrame, n: int) -> DataFrame:
    """One row a document: id, batch, pos, n, the 128-bit name of its set, and (in the first row of some batches) the tokens that are
    frequent in the documents counted up to there, COUNTED_DOCS or a task's last ones."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = packed.WordHashes()
        kind = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))
        counted: list[np.ndarray] = []
        for rb in rows:
            for r in range(rb.num_rows):
                number, ids, sizes, blob = (c[r].as_py() for c in rb.columns)
                sets = list(_sets(Batch(blob, sizes), range(len(ids)), n, hashes))
                k1 = [int(packed.mix(s).sum(dtype=np.uint64)) - (1 << 63) for s in sets]
                k2 = [int(packed.mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)) - (1 << 63) for s in sets]
                often: list = [None] * len(sets)
                counted += sets
                if len(counted) >= COUNTED_DOCS or r == rb.num_rows - 1:
                    tokens, counts = np.unique(np.concatenate(counted), return_counts=True)
                    many = counts >= max(4, len(counted) // 700)
                    often[0] = [{"token": t, "n": c} for t, c in zip(tokens[many].view(np.int64).tolist(), counts[many].tolist(), strict=True)]
                    counted = []
                longs = ([number] * len(ids), range(len(ids)), map(len, sets), k1, k2)
                arrays = [pa.array(ids, pa.int64()), *[pa.array(list(x), pa.int64()) for x in longs], pa.array(often, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "batch", "pos", "n", "k1", "k2", "often"])

    schema = "id long, batch long, pos long, n long, k1 long, k2 long, often array<struct<token:bigint,n:bigint>>"
    return written(stored.select("batch", "ids", "sizes", "texts").mapInArrow(returned_memory(run), schema), "shingled")


def _sets(batch: Batch, places, n: int, hashes: packed.WordHashes) -> Iterator[np.ndarray]:
    """The sets of some documents of a batch."""
    for i in places:
        yield shingles(batch.data[batch.ends[i - 1] if i else 0 : batch.ends[i]].tobytes(), n, hashes)


def _asked(stored: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """The batches that rows (batch, fields) name, each with its rows, `asked`; texts are not shuffled, as batches are bucketed."""
    per = rows.groupBy("batch").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return stored.select("batch", "ids", "sizes", "texts").join(per, "batch").select("sizes", "texts", "asked")


def _keyed(flat: np.ndarray, ids: np.ndarray, total: int, pack) -> pa.RecordBatch:
    """Keys and the nodes that send them, by bucket."""
    order = np.argsort(flat)
    flat, ids = flat[order], ids[order]
    buckets, edges = by_bucket(flat, total)
    short, spans = shortened(flat), list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    blobs = [[short[a:b].tobytes() for a, b in spans], [pack(ids[a:b].tobytes()) for a, b in spans]]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], ["bucket", "keys", "ids"])


def _met(sent: DataFrame, total: int) -> DataFrame:
    """(u, v): nodes that send one key, as stars around the smallest number of each key."""

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for _, parts in grouped(rows):
            keys = np.concatenate([lengthened(p[0]) for p in parts])
            ids = np.concatenate([np.frombuffer(unpack(p[1]), np.int64) for p in parts])
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            first = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1])
            head = np.repeat(ids[first], np.diff(np.concatenate([first, [len(keys)]])))
            pairs = np.unique(np.stack([ids, head], axis=1)[ids != head], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["u", "v"])

    return dealt(sent, total).mapInArrow(returned_memory(meet), "u long, v long")


def _routes(stored: DataFrame, reps: DataFrame, frequent, n: int, percent: int, total: int) -> DataFrame:
    """(u, v): classes that share a part, as stars around the smallest number of each part."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = packed.WordHashes(), zstandard.ZstdCompressor(1).compress
        for rb in rows:
            for r in range(rb.num_rows):
                sizes, blob, asked = (c[r].as_py() for c in rb.columns)
                keys = [part_keys(s, percent, *frequent.value) for s in _sets(Batch(blob, sizes), [a["pos"] for a in asked], n, hashes)]
                ids = np.repeat(np.array([a["node"] for a in asked], np.int64), [len(k) for k in keys])
                flat = np.concatenate(keys)
                yield _keyed(flat, ids, total, pack)

    sent = _asked(stored, reps, ["pos", "node"]).mapInArrow(returned_memory(send), "bucket long, keys binary, ids binary")
    return _met(sent, total)


def _all_parts(batch: Batch, asked: list, n: int, percent: int, hashes: packed.WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of all parts in all schemes of some documents of a batch, apart for each block; of each key the scheme's number, and of
    each scheme the node and how many parts it may leave out."""
    keys, nodes, spares = [], [], []
    for a, tokens in zip(asked, _sets(batch, [a["pos"] for a in asked], n, hashes), strict=True):
        for differ, prefix in _schemes(len(tokens), percent):
            spare, _, found = _parts(tokens, differ, prefix)
            keys.append(packed.mix(found ^ np.uint64(a["block"])))
            nodes.append(a["node"])
            spares.append(spare)
    return np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.array(nodes, np.int64), np.array(spares, np.int64)


def chosen_parts(level: np.ndarray, scheme: np.ndarray, spares: np.ndarray) -> np.ndarray:
    """Which parts are sent: of each scheme those shared by several (level over 0), without the most common ones, `spares` of it at most."""
    order = np.lexsort((-level.astype(np.int64), scheme))
    start = np.searchsorted(scheme[order], np.arange(len(spares)))
    most = level[order][start + spares]
    return (level > 0) & (level <= most[scheme])


def _refined(stored: DataFrame, members: DataFrame, n: int, percent: int, total: int) -> DataFrame:
    """(node, component) of (batch, pos, node, block): blocks routed once more, by how many sets of the block have each part. A set leaves
    out its most common parts, as many as `_scheme_keys` may: the weight is the rarity of the part, so texts with a passage in common
    part again unless they share a third of their parts with some other. Nodes of no shared part are not returned."""

    def fields(rows: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for rb in rows:
            for r in range(rb.num_rows):
                yield [c[r].as_py() for c in rb.columns]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack = packed.WordHashes(), zstandard.ZstdCompressor(1).compress
        for number, sizes, blob, asked in fields(rows):
            keys, held = np.unique(_all_parts(Batch(blob, sizes), asked, n, percent, hashes)[0], return_counts=True)
            buckets, edges = by_bucket(keys, total)
            short, held = shortened(keys), np.minimum(held, 1 << 30).astype("<i4")
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            blobs = [[short[a:b].tobytes() for a, b in spans], [pack(held[a:b].tobytes()) for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array([number] * len(spans), pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], ["bucket", "batch", "keys", "held"])

    def levels(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        for bucket, parts in grouped(rows):
            keys = [lengthened(p[1]) for p in parts]
            held = np.concatenate([np.frombuffer(unpack(p[2]), "<i4") for p in parts])
            _, of = np.unique(np.concatenate(keys), return_inverse=True)
            level = np.minimum(255, np.ceil(8 * np.log2(np.bincount(of, held)))).astype(np.uint8)[of]
            cuts = np.cumsum([0, *map(len, keys)])
            blobs = [pack(level[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([bucket] * len(parts), pa.int64()), pa.array(blobs, pa.binary())], ["batch", "bucket", "bits"])

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pack, unpack = packed.WordHashes(), zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        for _, sizes, blob, asked, answers in fields(rows):
            flat, scheme, nodes, spares = _all_parts(Batch(blob, sizes), asked, n, percent, hashes)
            distinct, of = np.unique(flat, return_inverse=True)
            found = {a["bucket"]: a["bits"] for a in answers}
            level = np.concatenate([np.frombuffer(unpack(found[b]), np.uint8) for b in by_bucket(distinct, total)[0].tolist()])[of]
            sent = chosen_parts(level, scheme, spares)
            yield _keyed(flat[sent], nodes[scheme[sent]], total, pack)

    fields_ = F.collect_list(F.struct("pos", "node", "block")).alias("asked")
    asked = stored.select("batch", "sizes", "texts").join(members.groupBy("batch").agg(fields_), "batch").select("batch", "sizes", "texts", "asked")
    counted = dealt(asked.mapInArrow(returned_memory(count), "bucket long, batch long, keys binary, held binary"), total)
    answers = written(answered(counted.mapInArrow(returned_memory(levels), "batch long, bucket long, bits binary"), "answers"), "levels")
    sent = asked.join(answers, "batch").select("batch", "sizes", "texts", "asked", "answers").mapInArrow(returned_memory(send), "bucket long, keys binary, ids binary")
    out = written(compact(components(_met(sent, total))), "parted")
    dropped(answers)
    return out


def _texts(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, block, tile, others (tiles that it is compared with) and the compressed text of the classes in blocks."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for rb in rows:
            for r in range(rb.num_rows):
                sizes, blob, asked = (c[r].as_py() for c in rb.columns)
                batch = Batch(blob, sizes)
                for start in range(0, len(asked), 500):
                    part = asked[start : start + 500]
                    texts = [pack(batch.data[batch.ends[a["pos"] - 1] if a["pos"] else 0 : batch.ends[a["pos"]]].tobytes()) for a in part]
                    cols = [pa.array([a[c] for a in part], k) for c, k in (("node", pa.int64()), ("block", pa.int64()), ("tile", pa.int32()), ("others", pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())], ["node", "block", "tile", "others", "text"])

    asked = _asked(stored, chosen, ["pos", "node", "block", "tile", "others"])
    return asked.mapInArrow(returned_memory(run), "node long, block long, tile int, others array<int>, text binary")


def _tiled(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """node, batch, pos, block, tile and others of (node, batch, pos, n, block): blocks of over `tile` sets in tiles of about that many, and
    for each set the tiles that it is compared with. In blocks of over BANDED tiles a tile has sets of one band of sizes, and meets
    its own and the bands beside it: sizes of linked sets are not as far apart as a band is wide."""
    width = math.log(max(1.3, 105 / percent))
    band = F.floor(F.log("n") / width).cast("int")
    per = members.withColumn("band", band).groupBy("block", "band").agg(F.count("*").alias("m"))
    sized = per.groupBy("block").agg(F.sum("m").alias("members"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / tile).cast("int")))).alias("bands"))
    tiles, broad = F.ceil(F.col("members") / tile).cast("int"), F.col("members") > BANDED * tile
    sized = sized.select("block", F.when(broad, F.col("bands")).alias("bands"), F.when(~broad, tiles).otherwise(0).alias("tiles"))
    joined = members.withColumn("band", band).join(sized, "block")
    own = F.col("bands")[F.col("band")]
    tile_ = F.when(F.col("bands").isNull(), F.pmod(F.xxhash64("node"), "tiles").cast("int")).otherwise(F.col("band") * TILES + F.pmod(F.xxhash64("node"), own).cast("int"))
    beside = [F.transform(F.sequence(F.lit(1), F.col("bands")[F.col("band") + d]), lambda i, d=d: (F.col("band") + d) * TILES + i - 1) for d in (-1, 0, 1)]
    beside = F.concat(*(F.coalesce(b, F.array().cast("array<int>")) for b in beside))
    others = F.when(F.col("bands").isNull(), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(beside)
    return joined.select("node", "batch", "pos", "block", tile_.cast("int").alias("tile"), others.cast("array<int>").alias("others"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, tile: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; links have a Jaccard index of percent / 100 or more."""
    _classes(1, percent)
    total = packed.buckets(docs)
    stored = batches(docs, doc_id, text, BATCH_BYTES)
    described = _described(stored, n)
    same = ["n", "k1", "k2"]
    usable = described.drop("often").filter(F.col("id").isNotNull() & (F.col("n") > 0))
    least = F.min(F.struct("id", "batch", "pos")).alias("least")
    classes = usable.groupBy(*same).agg(least).select(*same, F.col("least.id").alias("rep"), "least.batch", "least.pos")
    classes = written(compact(classes).withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = written(described.select("id", *same).join(classes.select(*same, "rep", "node"), same, "left").drop("k1", "k2"), "rows")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(described))
    blocks = written(compact(components(_routes(stored, classes.select("batch", "pos", "node"), frequent, n, percent, total))), "blocks")
    members = classes.select("node", "batch", "pos", "n").join(blocks.select("node", F.col("component").alias("block")), "node")
    large = blocks.groupBy("component").agg(F.count("*").alias("m")).filter(F.col("m") > tile).select(F.col("component").alias("block"))
    large = written(compact(members.join(large, "block")), "large")
    if large.head(1):
        parted = _refined(stored, large, n, percent, total).select("node", F.col("component").alias("block"))
        rest = members.join(large.select("node"), "node", "left_anti")
        members = rest.unionByName(members.drop("block").join(parted, "node"))
    texts = _texts(stored, _tiled(members, percent, tile))
    spread = texts.withColumn("with", F.explode("others")).select(
        "block", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"), "node", "tile", "text"
    )
    spread = spread.repartition("block", "a", "b").sortWithinPartitions("block", "a", "b")
    known = rows.filter("id IS NOT NULL AND node IS NOT NULL").select("id", "node")
    several = known.groupBy("id").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last")  # ids with several texts
    bridges = known.join(several, "id").filter("node > first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    linked = written(compact(components(_block_links(spread, n, percent).unionAll(bridges))), "linked")
    dropped(stored)
    smallest = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("smallest"))
    found = linked.join(smallest, "component").select("node", "smallest")
    own = F.when(F.col("n") > 0, F.coalesce("smallest", "rep")).otherwise(F.col("id"))
    return rows.join(found, "node", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
