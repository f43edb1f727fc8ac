"""Byte-level BPE encoding and decoding with two tiers of lookup.

First tier: a minimal perfect hash (hash and displace, one slot for each vocabulary entry) tells whether a
whole pre-token is a vocabulary entry; the entry stored in the slot is compared, so a stranger isn't taken
for one. Second tier: other pre-tokens are merged with a heap of adjacent pairs over a linked list of bytes,
lowest rank first, leftmost on ties, in O(n log n) for a pre-token of n bytes.

What a pre-token becomes is remembered by each worker, from task to task, in two generations of at most ``MEMO``
entries.

Scale: documents are only scanned. The vocabulary has a fixed size, is read by the driver, checked against
``MAX_VOCABULARY_BYTES`` and broadcast.

Defined cases: null text is empty (no ids); an empty table gives no rows; ids that the vocabulary lacks make
``decode`` raise KeyError. Rows are independent, so repeated rows give equal results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MAX_VOCABULARY_BYTES = 64 << 20
MEMO = 150_000
_NONE = 1 << 62


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: slot(key) in 0..n-1, another one for each key."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 4)
        groups: dict[int, list[bytes]] = {}
        for k in keys:
            groups.setdefault(xxhash.xxh3_64_intdigest(k) % self.buckets, []).append(k)
        free, self.displace = np.ones(n, bool), [0] * self.buckets
        for bucket, group in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(group) == 1:
                break
            seed = 1
            while True:
                slots = {xxhash.xxh64_intdigest(k, seed) % n for k in group}
                if len(slots) == len(group) and all(free[s] for s in slots):
                    break
                seed += 1
            self.displace[bucket] = seed
            free[list(slots)] = False
        left = iter(np.flatnonzero(free).tolist())
        for bucket, group in sorted(groups.items()):
            if len(group) == 1:  # a free slot, named directly
                self.displace[bucket] = -1 - next(left)

    def slot(self, key: bytes) -> int:
        d = self.displace[xxhash.xxh3_64_intdigest(key) % self.buckets]
        return -1 - d if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n


class Vocabulary:
    """Ranks of a tiktoken file, with both tiers of lookup."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks))
        self.entries: list[tuple[bytes, int]] = [(b"", -1)] * self.hash.n
        for token, rank in ranks.items():
            self.entries[self.hash.slot(token)] = token, rank
        self.texts = {rank: token for token, rank in ranks.items()}

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "hash": self.hash, "entries": self.entries}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.texts = {rank: token for token, rank in self.ranks.items()}

    def whole(self, piece: bytes) -> int:
        """The rank of a pre-token that is a vocabulary entry, else -1."""
        token, rank = self.entries[self.hash.slot(piece)]
        return rank if token == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ranks of the parts of a pre-token after all merges."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))  # of parts, by their first byte
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2], _NONE)) != _NONE]
        heapify(heap)
        dead = bytearray(n + 1)
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if dead[i] or mid >= n or after[mid] != end:
                continue
            dead[mid] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]], _NONE)) != _NONE:
                    heappush(heap, (r, i, after[end]))
            if (j := before[i]) >= 0:
                if (r := rank(piece[j:end], _NONE)) != _NONE:
                    heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pretoken(self, piece: bytes) -> list[int]:
        return [r] if (r := self.whole(piece)) >= 0 else self.merge(piece)


class Memo(dict):
    """Pre-token -> its ids as little-endian 32-bit integers; bounded by two generations."""

    def __init__(self, vocabulary: Vocabulary, most: int = MEMO):
        self.vocabulary, self.most, self.old = vocabulary, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(self.vocabulary.pretoken(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self.memo = Memo(vocabulary)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: list[Codec] = []


def codec(vocabulary: Vocabulary) -> Codec:
    """This worker's codec for a vocabulary that was sent to it; another vocabulary replaces it."""
    if not _codecs or _codecs[0].vocabulary is not vocabulary:
        _codecs[:] = [Codec(vocabulary)]
    return _codecs[0]


_loaded: dict[tuple[str, str], Vocabulary] = {}


def load(path: str, pattern: str) -> Vocabulary:
    """Read a tiktoken file: one base64 token and its rank on a line. The last one is kept, by the digest of the file."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    if (key := (shared.sha(raw), pattern)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, pattern)
    return _loaded[key]


def _digests(broadcast, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(broadcast.value)
    for b in batches:
        ids = [own.encode(t) for t in b["text"].to_pylist()]
        arrays = [b["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([shared.sha(x) for x in ids], pa.string()), pa.array([shared.sha(own.decode(x)) for x in ids], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays, names = [*arrays, _ids(ids)], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def _ids(packed: list[bytes]) -> pa.ListArray:
    """Packed ids as lists of int."""
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def _encode(broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(broadcast.value)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), _ids([own.encode(t) for t in b["text"].to_pylist()])], [*b.schema.names, "ids"])


def _decode(broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(broadcast.value)
    for b in batches:
        raw = [None if x is None else own.decode(np.array(x, "<u4").tobytes()) for x in b["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "ids"), pa.array(raw, pa.binary())], [*(c for c in b.schema.names if c != "ids"), "decoded"])


def _shipped(df: DataFrame, vocabulary: Vocabulary):
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def digests(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, with ids encoded and decoded again.

    with_ids: also the ids themselves (array of int).
    """
    sent = _shipped(docs, vocabulary)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(shared.lean(lambda it: _digests(sent, with_ids, it)), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text and ids (array of int) of each row."""
    sent = _shipped(docs, vocabulary)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(shared.lean(lambda it: _encode(sent, it)), "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and decoded (bytes) of each row's ids."""
    sent = _shipped(encoded, vocabulary)
    slim = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<long>").alias("ids"))
    return slim.mapInArrow(shared.lean(lambda it: _decode(sent, it)), "doc_id long, decoded binary")
