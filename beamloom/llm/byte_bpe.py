"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece the table holds the one token that ends the prefix's encoding.
A token t may end a prefix if the rest of the prefix ends with a token p and the pair (p, t)
is stable: encoding the bytes of p and t together gives p and t again. Exactly one token
meets this for each prefix, so an encoding is read off backwards, bytes can be appended
without touching earlier entries, and after an edit only the entries near it change.

Defined results: a null text is encoded as an empty one (no ids); repeated rows are encoded
as often as they occur; an empty table gives an empty result; lone surrogates cannot occur in
Spark strings; very long pieces take time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamloom.llm.shared import returned_memory

#: Bytes of the pieces that each Python worker keeps encoded, with what an entry takes beside them; a full memo keeps those that the texts at hand have.
CACHED_BYTES, ENTRY_BYTES = 128_000_000, 200
#: Longer pieces are encoded each time.
CACHED_PIECE = 64
#: Pairs of tokens whose stability a worker keeps.
CACHED_PAIRS = 300_000
#: Share of the memos that a worker may keep between two tasks.
LEFT_SHARE = 0.125
#: Characters of text split into pieces at a time.
CHUNK_CHARS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    """Encoder and decoder of single pieces and of whole texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 1:
                lengths.setdefault(token[-4:], {1}).add(len(token))
        for key, found in lengths.items():
            found.update(n for n in (2, 3) if n < len(key) and key[-n:] in ranks)
        #: Lengths of the tokens that may end where these four bytes do (or three or two, where no longer token ends so), longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.find = regex.compile(pattern).findall
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._stable: dict[int, bool] = {}
        self._reach: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo of pieces

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for one byte, (b"", b"") if no merges reach it."""
        if token not in self._halves:
            self._halves[token] = None if len(token) == 1 else self._last_merge(token)
        return self._halves[token]

    def _last_merge(self, token: bytes) -> tuple[bytes, bytes]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not pairs:
                return b"", b""
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else (b"", b"")

    def stable(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, encoded together, give these two tokens.

        The boundary is crossed only if, at some moment of the two merge histories, the token
        that ends the left history and the one that starts the right history merge before
        either of them grows. The histories are walked back from the finished tokens: the one
        whose last merge came later (rank; at a tie the right one, as merges run from the
        left) is undone first.
        """
        key = left << 32 | right
        if (known := self._stable.get(key)) is not None:
            return known
        rank, before, ties, result = self.ranks, float("inf"), False, True
        x, y = self.tokens[left], self.tokens[right]
        while True:
            joined = rank.get(x + y)
            if joined is not None and (joined < before or ties and joined == before):
                result = False
                break
            a, b = self._split(x), self._split(y)
            if a is None and b is None:
                break
            if b is None or a is not None and rank[x] > rank[y]:
                before, ties, x = rank[x], False, a[1]  # type: ignore[index]
            else:
                before, ties, y = rank[y], True, b[0]
        if len(self._stable) > CACHED_PAIRS:
            self._stable.clear()
        self._stable[key] = result
        return result

    def _reached(self, token: int) -> bool:
        if token not in self._reach:
            self._reach[token] = self._split(self.tokens[token]) != (b"", b"")
        return self._reach[token]

    def extend(self, data: bytes, last: list[int], start: int) -> None:
        """Sets last[start:] to the last tokens of the prefixes of data that end there."""
        get, stable, known, reach, lengths = self.ranks.get, self.stable, self._stable, self._reach, self.lengths.get
        del last[start:]
        for end in range(start + 1, len(data) + 1):
            near = max(0, end - 4)
            for n in lengths(data[near:end]) or lengths(data[end - 3 : end] if end > 3 else b"") or lengths(data[end - 2 : end] if end > 2 else b"", (1,)):
                if n > end:
                    continue
                begin = end - n
                token = get(data[begin:end])
                if token is None:
                    continue
                if begin and not (stable(last[begin - 1], token) if (s := known.get(last[begin - 1] << 32 | token)) is None else s):
                    continue
                if reach.get(token) or self._reached(token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes; the ranks lack single bytes")

    def read_off(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[out[-1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last, 0)
        return self.read_off(last)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Pieces that aren't cached are encoded in sorted order: one that shares its start with the
        piece before it keeps that part of the table and is appended from there.
        """
        found = [self.find(text) for text in texts]
        asked = set().union(*found)
        self.trim(1.0, asked)
        new = asked - self.pieces.keys()
        long: dict[str, bytes] = {}
        before, last = b"", []
        for data in sorted(x.encode() for x in new):
            if (whole := self.ranks.get(data)) is not None:
                packed = whole.to_bytes(4, "little")
            else:
                same = next((i for i, (x, y) in enumerate(zip(before, data, strict=False)) if x != y), min(len(before), len(data)))
                self.extend(data, last, same)
                before = data
                packed = struct.pack(f"<{len(ids := self.read_off(last))}I", *ids)
            if len(data) > CACHED_PIECE:
                long[data.decode()] = packed
            else:
                self.pieces[data.decode()] = packed
                self.held += len(data) + len(packed) + ENTRY_BYTES
        if not long:
            return [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in found]
        return [b"".join([self.pieces[p] if p in self.pieces else long[p] for p in pieces]) for pieces in found]

    def trim(self, share: float, asked: set[str] = frozenset()) -> None:
        """Empties the memos that hold more than a share of what they may, but for the pieces asked for now."""
        if self.held > share * CACHED_BYTES:
            self.pieces = {p: self.pieces[p] for p in asked & self.pieces.keys()}
            self.held = sum(len(p.encode()) + len(ids) + ENTRY_BYTES for p, ids in self.pieces.items())
        if len(self._stable) > share * CACHED_PAIRS:
            self._stable.clear()

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_all([text])[0]).cast("I").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableEncoding:
    """The encoding of one piece that follows appends and edits without encoding it anew."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.bpe.extend(self.data, self.last, start)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in the place of [start, end); returns how many entries were computed.

        Behind the edit, once as many entries in a row as the longest token has bytes equal
        the old ones, every later entry is the old one too.
        """
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        last, same = old[:start], 0
        while len(last) < len(self.data):
            at = len(last)
            self.bpe.extend(self.data[: at + 1], last, at)
            same = same + 1 if at - shift >= end and old[at - shift] == last[at] else 0
            if same >= self.bpe.longest:
                done = len(last)
                self.last = last + old[done - shift :]
                return done - start
        self.last = last
        return len(last) - start

    def ids(self) -> list[int]:
        return self.bpe.read_off(self.last)


def _packed(bpe: PrefixBPE, column: pa.Array) -> Iterator[bytes]:
    chunk, size = [], 0
    for value in column:
        chunk.append(value.as_py() or "")
        size += len(chunk[-1])
        if size > CHUNK_CHARS:
            yield from bpe.encode_all(chunk)
            chunk, size = [], 0
    yield from bpe.encode_all(chunk)


_ENCODERS: dict[tuple[bytes, str], PrefixBPE] = {}


def _encoder(raw: bytes, pattern: str) -> PrefixBPE:
    """One encoder for each vocabulary and worker process."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False, check: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, and either ids (array<int>) and decoded (binary), or their digests.

    A map without a shuffle. The rank file, read where the query is built, goes to the executors
    as a broadcast of its fixed size. With `digests` the ids never leave the worker: n_tokens,
    ids_sha256 and decoded_sha256 are returned. Other columns of docs are not returned.
    """
    with open(ranks_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, " + ("round_trip boolean" if check else "decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(raw.value, pattern)
        for batch in batches:
            rows: list[list] = [[], [], []]
            values = (value.as_py() or "" for value in batch.column(1)) if check else iter(())
            for packed in _packed(bpe, batch.column(1)):
                ids = memoryview(packed).cast("I").tolist()
                decoded = bpe.decode(ids)
                if digests:
                    new = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest())
                else:
                    new = (ids, decoded == next(values).encode() if check else decoded)
                for into, x in zip(rows, new, strict=False):
                    into.append(x)
            if digests:
                arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                arrays = [pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.bool_() if check else pa.binary())]
                names = ["ids", "round_trip" if check else "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [doc_id, *names])
        bpe.trim(LEFT_SHARE)  # the worker may serve other stages next

    picked = docs.select(F.col(doc_id), F.col(text).cast("string"))
    return picked.mapInArrow(returned_memory(run), f"`{doc_id}` {kind.simpleString()}, {out}")
