"""Token files with fixed-width bit packing.

A file holds whole documents in ascending document order. All integers are little-endian:

====================  =========================================================
8 bytes               magic ``BLTOKEN1``
uint32                bits per id
uint32                ids per block
uint64                number of ids
uint64                number of documents
uint64 x documents    end of each document, in ids from the file's start
uint64 x (blocks+1)   offset of each block's first byte, from the first block
blocks                ids, `bits` bits each, low bits first; each block starts on a byte
====================  =========================================================

Block offsets let a reader unpack any range of ids without reading what stands before it.
The images are stored in a Parquet table in the shared folder, one row a file, as executors
can only reach the cluster's storage through Spark; ``export`` writes them out as plain files.

Defined results: a null text is an empty one and has only the end id; strings of special tokens in a
text are these tokens, as the library's `encode` takes them; texts of any length are taken whole
(a document is never cut over two files); repeated rows are repeated documents, null ids come
first; an empty table gives no file and an empty result; other columns of the input, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beamloom.llm.shared import written

MAGIC = b"BLTOKEN1"
BLOCK = 4096
#: A file is closed once it holds so many ids.
FILE_IDS = 4_000_000
#: Bytes of the words that each Python worker keeps encoded, with what an entry takes beside them; the memo is emptied when full.
CACHED_BYTES, ENTRY_BYTES = 128_000_000, 200
#: Longer words are encoded each time.
CACHED_WORD = 64
MARKS = ".,;:!?*%$#&|()-"
#: Characters of text encoded at a time.
CHUNK_CHARS = 2_000_000


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`bits` low bits of each id, one after the other, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build(ids: np.ndarray, ends: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The image of one file."""
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = MAGIC + struct.pack("<IIQQ", bits, block, len(ids), len(ends))
    return b"".join([head, ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Random access to one image."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token file")
        self.image = memoryview(image)
        self.bits, self.block, self.n_ids, self.n_docs = struct.unpack_from("<IIQQ", image, 8)
        at = 32
        self.ends = np.frombuffer(image, "<u8", self.n_docs, at)
        at += 8 * self.n_docs
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(image, "<u8", blocks + 1, at)
        self.data = at + 8 * (blocks + 1)

    def read(self, start: int, end: int) -> np.ndarray:
        """ids [start, end); only the blocks that hold them are unpacked."""
        end = min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            lo, hi = int(self.offsets[b]), int(self.offsets[b + 1])
            parts.append(unpack(self.image[self.data + lo : self.data + hi], self.bits, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class _Words:
    """Encodes texts word by word; words not met before go to the library together."""

    def __init__(self, raw: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        self.known: dict[str, bytes] = {}
        self.held = 0
        spec = json.loads(raw)
        # strings that the library looks for in whole texts, before it parts words
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(added), re.I) if added else None
        self.lowers = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_word(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        known, found, new = self.known, [], set()
        for text in texts:
            if self.added and self.added.search(text):
                found.append(None)
                continue
            words = self.folded(text).replace("\n", " ").split(" ")
            ids = list(map(known.get, words))
            holes = [(i, words[i]) for i, v in enumerate(ids) if v is None]
            new.update(w for _, w in holes)
            found.append((ids, holes))
        long = self.learn(new)
        out = []
        for text, parts in zip(texts, found, strict=True):
            if parts is None:
                out += self.whole([text])
                continue
            ids, holes = parts
            for i, w in holes:
                ids[i] = known[w] if w in known else long[w]
            out.append(b"".join(ids))
        return out

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Adds words to `known` and returns the long ones, which aren't kept. Marks behind a letter are pieces of their own
        for the tokenizer's pattern."""
        known, letters, rest, cut = dict(), set(), set(), []
        for w in new:
            if "İ" in w:  # its lower case ends with a mark
                rest.add(w)
            elif w.isalpha():
                letters.add(w)
            elif (base := w.rstrip(MARKS)) != w and base[-1:].isalpha():
                cut.append((w, base, tail := w[len(base) :]))
                rest.add(tail)
                (letters if base.isalpha() else rest).add(base)
            else:
                rest.add(w)
        for words, encode in ((letters, self.runs), (rest, self.whole)):
            known.update((w, self.known[w]) for w in words if w in self.known)
            missing = [w for w in words if w not in known]
            known.update(zip(missing, encode(missing), strict=True))
        for w, base, tail in cut:
            known[w] = known[base] + known[tail]
        long = {w: known.pop(w) for w in [w for w in known if len(w) > CACHED_WORD]}
        self.held += sum(len(w) + len(v) + ENTRY_BYTES for w, v in known.items() if w not in self.known)
        self.known.update(known)
        return long

    def folded(self, text: str) -> str:
        """The text in lower case if the tokenizer does just this to it anyway, so that fewer words differ."""
        if self.lowers and "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return text

    def runs(self, words: list[str]) -> list[bytes]:
        """Ids of words that are single runs of letters: one call, cut at the tokens that end a word."""
        if self.ends is not None and words:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            at = np.nonzero(self.ends[ids])[0] + 1
            if len(at) == len(words) and at[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * at).tolist()
                return [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)]
        return self.whole(words)


def splits_at_blanks(raw: str) -> bool:
    """Whether a tokenizer file drops white space before it merges, so that words can be encoded one by one."""
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s" in json.dumps(first["pattern"]).replace("\\\\", "\\")


_WORDS: dict[int, tuple[str, _Words]] = {}


def _encoded(raw: str, column: pa.Array, by_word: bool) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; texts are taken in chunks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if 0 not in _WORDS or _WORDS[0][0] != raw:
        _WORDS[0] = (raw, _Words(raw))
    encode = _WORDS[0][1].by_word if by_word else _WORDS[0][1].whole
    chunk, size = [], 0
    for value in column:
        chunk.append(value.as_py() or "")
        size += len(chunk[-1])
        if size > CHUNK_CHARS:
            yield from encode(chunk)
            chunk, size = [], 0
    yield from encode(chunk)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text",
    file_ids: int = FILE_IDS, partitions: int | None = None,
) -> DataFrame:
    """Encodes docs and stores files in the shared folder; returns their table.

    Columns: part, file (order of the files), doc_ids (array), n_ids, image. Texts are
    range partitioned by doc_id and sorted inside a partition, nulls first and ties by text, so
    files are in ascending order and no task holds more than one file and one batch. A null text
    is an empty one and has only the end id. Repeated rows are repeated documents.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    by_word = splits_at_blanks(raw)
    spec = json.loads(raw)
    vocabulary = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or []), end_id or 0]) + 1
    bits = bits_for(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, parts, ends, total, n = [], [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal n
            image = build(np.frombuffer(b"".join(ids), "<u4"), np.array(ends), bits)
            row = [pa.array([parts[0]], pa.int32()), pa.array([n], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([total], pa.int64()), pa.array([image], pa.binary())]
            n += 1
            return pa.RecordBatch.from_arrays(row, ["part", "file", "doc_ids", "n_ids", "image"])

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _encoded(shared.value, batch.column(2), by_word), strict=True)
            for part, key, packed in rows:
                ids += [packed, tail]
                total += (len(packed) + len(tail)) // 4
                ends.append(total)
                keys.append(key)
                parts.append(part)
                if total >= file_ids:
                    yield close()
                    ids, keys, parts, ends, total = [], [], [], [], 0
        if ends:
            yield close()

    ranged = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    order = [F.asc_nulls_first("k")]
    ranged = ranged.repartitionByRange(partitions, *order) if partitions else ranged.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order, "t").select(F.spark_partition_id().alias("part"), "k", "t")
    return written(ranged.mapInArrow(run, "part int, file int, doc_ids array<long>, n_ids long, image binary"), "token-files")


def read_token_files(files: DataFrame, digests: bool = False) -> DataFrame:
    """One row per document from the stored images: doc_id, start, n_tokens, and ids or ids_crc32.

    Images are read where they lie. The starts of files come in behind them: a running sum over the parts (one row each,
    as many as the writer had range partitions), and inside each part over its files.
    """
    sized = written(files.select("part", "file", "n_ids"), "file-sizes")
    over = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", over(Window.orderBy("part")).alias("base"))
    inner = sized.select("part", "file", over(Window.partitionBy("part").orderBy("file")).alias("within"))
    starts = written(inner.join(parts, "part").select("part", "file", (F.col("base") + F.col("within")).alias("first")), "file-starts")
    out = "ids_crc32 long" if digests else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, number, keys = (batch.column(c)[r].as_py() for c in ("part", "file", "doc_ids"))
                file = TokenFile(batch.column("image")[r].as_buffer().to_pybytes())
                ids = file.read(0, file.n_ids).astype("<u4")
                at = np.concatenate([[0], file.ends.astype(np.int64)])
                if digests:
                    raw = memoryview(ids.tobytes())
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.uint32()).cast(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array([number] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), last],
                    ["part", "file", "doc_id", "at", "n_tokens", "ids_crc32" if digests else "ids"],
                )

    read = files.select("part", "file", "doc_ids", "image").mapInArrow(run, f"part int, file int, doc_id long, at long, n_tokens long, {out}")
    return read.join(starts, ["part", "file"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", out.split()[0])


def export(files: DataFrame, folder: str) -> list[str]:
    """Writes the images as plain files into a local folder, one at a time; returns their names in order."""
    names = []
    for row in files.select("part", "file", "image").orderBy("part", "file").toLocalIterator():
        names.append(f"{row['part']:06d}-{row['file']:06d}.tok")
        Path(folder, names[-1]).write_bytes(bytes(row["image"]))
    return names
