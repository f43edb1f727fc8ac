"""Substring dedup with a log-structured index of window fingerprints.

A window is 13 consecutive words of one document. Each word has a keyed 128-bit hash of its bytes, two numbers of 64
bits; the key is random for each index. From the first numbers of 6 words a span's hash is made; the smallest of a
window's eight spans is its *representative* (48 bits). Equal windows have equal representatives, and
neighbouring windows mostly share one, so there are about four times fewer of them than windows. A window's
*fingerprint* is made from all 13 words: 64 bits from the first numbers, and its bucket from the second ones.

The index holds sorted immutable runs: in each bucket, the sorted representatives and the sorted fingerprints of
historical windows. A new batch goes through these steps:

1. the batch's representatives are merge-joined, bucket by bucket, with those of all runs and of the other blocks
   of the batch: which of them occur in the index or in two documents?
2. candidates are verified: the fingerprints of windows under such representatives (and of no others) are
   merge-joined with the runs and each other; the smallest doc_id that has a window owns it;
3. words covered by windows of another owner are removed;
4. windows that the batch owns become a new run, one sorted row a bucket. ``FAN_OUT`` runs of one level are merged
   into a run of the next level. A manifest in the index's folder names the runs, so an index can be opened again.

"Verified" is a comparison of keyed hashes, not of texts: two windows are taken as equal if bucket and fingerprint
agree. With N windows and B buckets about N * N / (2 * B * 2**64) pairs are expected to be taken wrongly: 3 in
10,000 runs at 30 GB of input, one in all at 100 TB. The key is random, so nobody can prepare words that collide.

Batches must come in the order of doc_id: what is in the index is older than the batch. One batch is added at a time.

Scale: documents are dealt once by a hash into blocks of about ``BLOCK_BYTES``, and all steps of a batch are one
query, in which Spark reuses that exchange; blocks and buckets exchange packed arrays (6 bytes a representative, 12 a
candidate window), and bits come back. A block visits only the buckets it has something for. A representative or
window that very many documents have is one entry for each block, and the different windows under a common
representative are spread over all buckets by their own hashes. There are as many buckets as the input has
``BUCKET_BYTES``, so memory per task doesn't grow with it. An exchanged row holds fewer entries the larger the input
is, one at the least; the number of entries is in proportion to the input. No row is a pair of documents.

Defined cases: null text has no words; a text of fewer than 13 words has no window; rows of one doc_id are
one document's (none is smaller than the other); a row with a null doc_id is left as it is and is not
indexed; an empty table gives no rows; words that are removed are removed whatever else is left, so a text may
become empty.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, SPAN = 13, 6
BLOCK_BYTES = 4 << 20
#: Text bytes of the whole input whose windows share a bucket.
BUCKET_BYTES = 8 << 20
#: So many runs of one level are merged into one of the next.
FAN_OUT = 2
#: Batches of dedup(): the first two are equal, each later one is as large as all before it.
BATCHES = 4

# Odd multipliers of the polynomials over word hashes.
_SPAN_BASE, _PRINT_BASE, _BUCKET_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: The lowest 0 to 8 bytes of a 64-bit number.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_EXACT = 32


def word_hashes(key: bytes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each white-space word of all texts in order, and the number of words of each text.

    Words of up to 32 bytes go in whole, 8 bytes a round, each round a bijection of what it takes in; longer ones
    by BLAKE2b. Both are keyed.
    """
    data = b" ".join(texts) + b" " * (_EXACT + 8)
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate(([0], edge))
    start, n = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the 8 bytes from each place on
    part = lambda k, at, size: eight[at + 8 * k] & _LOW[np.clip(size - 8 * k, 0, 8)]
    k0, k1 = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), "<u8")
    one, two = part(0, start, n), part(1, start, n)
    size = n.astype(np.uint64)
    a, b = mix(mix(mix(size ^ k0) ^ one) ^ two), mix(mix(mix(size ^ k1) ^ two) ^ one)
    longer = np.flatnonzero(n > 16)
    if len(longer):
        at, m = start[longer], n[longer]
        three, four = part(2, at, m), part(3, at, m)
        a[longer], b[longer] = mix(mix(a[longer] ^ three) ^ four), mix(mix(b[longer] ^ four) ^ three)
    for i in np.flatnonzero(n > _EXACT).tolist():
        digest = hashlib.blake2b(data[start[i] : start[i] + n[i]], digest_size=16, key=key).digest()
        a[i], b[i] = np.frombuffer(digest, "<u8")
    ends = np.cumsum([len(t) + 1 for t in texts])
    return a, b, np.diff(np.searchsorted(start, ends), prepend=0)


def polynomial(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of every run of k values, one for each start but the last k - 1, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, at = np.zeros(n, np.uint64), h, 1, 0  # have: runs of `power` values
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            out = out * np.uint64(pow(base, power, 1 << 64)) + have[at : at + n]
            at += power
        if k >> (bit + 1):
            have = have[:-power] * np.uint64(pow(base, power, 1 << 64)) + have[power:]
            power *= 2
    return mix(out)


def ranges(x: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of each value of so many bits: equal ranges of its upper 32."""
    return ((x >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    if not len(sorted_):
        return []
    at = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)])).tolist()
    return list(zip(at, at[1:]))


def _is_in(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """A merge join of two sorted arrays: which of x the other one has."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return sorted_[at] == x


def _merged(arrays: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of sorted arrays. The stable sort takes their order over and only merges."""
    out = np.sort(np.concatenate(arrays), kind="stable") if arrays else np.empty(0, np.uint64)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def _pack6(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(blob: bytes | None) -> np.ndarray:
    out = np.zeros((len(blob or b"") // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob or b"", np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _u8(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<u8")


def _pack_ids(x: np.ndarray) -> bytes:
    """Integers as the least one and the differences from it, in as few bytes as they need."""
    low = int(x.min())
    gaps = (x.astype(np.int64).view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)).astype("<u8")
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(gaps.max()) < 1 << (8 * w))
    return bytes([width]) + low.to_bytes(8, "little", signed=True) + gaps.astype(f"<u{width}").tobytes()


def _unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=9).astype(np.uint64).view(np.int64) + np.int64(int.from_bytes(blob[1:9], "little", signed=True))


def _bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8))[:n].astype(bool)


class Block:
    """The windows of a block's documents, in order of document and place, and how they are filed."""

    def __init__(self, t: pa.Table, key: bytes, buckets: int):
        self.rows = t = t.take(pc.sort_indices(t, [("doc_id", "ascending"), ("text", "ascending")]))
        self.buckets, self.number = buckets, t["block"][0].as_py()
        self.ids, self.texts = t["doc_id"].to_pylist(), [shared.utf8(x) for x in t["text"].to_pylist()]
        self._a, self._b, self.n_words = word_hashes(key, self.texts)
        self.first = np.cumsum(self.n_words) - self.n_words
        n = np.where([i is not None for i in self.ids], np.maximum(self.n_words - WINDOW + 1, 0), 0)
        self.start = np.arange(n.sum()) + np.repeat(self.first - (np.cumsum(n) - n), n)
        self.doc = np.repeat(np.array([i or 0 for i in self.ids], np.int64), n)
        least = polynomial(self._a, SPAN, _SPAN_BASE)
        for k in (1, 2, 4):  # the minimum of 8 spans by doubling
            least = np.minimum(least[:-k], least[k:])
        # Minima crowd at small hashes; mixed again they fill all buckets evenly.
        every = mix(least[self.start]) >> np.uint64(16) if n.sum() else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        at = np.array([a for a, _ in _cuts(every[order])], np.int64)
        last = np.append(at[1:], len(order))[: len(at)] - 1
        self.rep = every[order[at]]
        self.of_rep = np.empty(len(order), np.int64)  # of each window: the place of its representative
        self.of_rep[order] = np.repeat(np.arange(len(at)), last - at + 1)
        self.several = self.doc[order[at]] != self.doc[order[last]]  # two of the block's documents have it
        self.rep_bucket = ranges(self.rep, 48, buckets)

    def emit_reps(self) -> list[tuple]:
        return [(int(self.rep_bucket[a]), self.number, _pack6(self.rep[a:b]), np.packbits(self.several[a:b]).tobytes()) for a, b in _cuts(self.rep_bucket)]

    def prints(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, bucket) of some windows."""
        b = polynomial(self._b, WINDOW, _BUCKET_BASE)
        at = self.start[windows]
        return polynomial(self._a, WINDOW, _PRINT_BASE)[at], ranges(b[at], 64, self.buckets)

    def answered(self, back: pa.Table, kind: int, buckets: np.ndarray) -> np.ndarray:
        """Bits that came back for entries sorted by bucket; a bucket without an answer says no."""
        bits = {b: d for k, b, d in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["data"].to_pylist()) if k == kind}
        out = np.zeros(len(buckets), bool)
        for a, b in _cuts(buckets):
            if (blob := bits.get(int(buckets[a]))) is not None:
                out[a:b] = _bits(blob, b - a)
        return out


class Candidates:
    """A block's candidate windows: distinct fingerprints, sorted by bucket, with the smallest doc_id of each."""

    def __init__(self, block: Block, back: pa.Table):
        hit = block.answered(back, 0, block.rep_bucket)
        self.windows = np.flatnonzero(hit[block.of_rep])
        fp, bucket = block.prints(self.windows)
        order = np.lexsort((fp, bucket))  # stable, so documents stay in order
        fp, bucket = fp[order], bucket[order]
        new = np.concatenate(([True], (fp[1:] != fp[:-1]) | (bucket[1:] != bucket[:-1]))) if len(fp) else np.empty(0, bool)
        self.windows, self.group = self.windows[order], np.cumsum(new) - 1
        self.fp, self.bucket, self.doc = fp[new], bucket[new], block.doc[self.windows][new]


_REPS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("reps", pa.binary()), ("several", pa.binary())])
_BACK = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
_PRINTS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("prints", pa.binary()), ("docs", pa.binary())])
_RUNS = pa.schema([("bucket", pa.int64()), ("reps", pa.binary()), ("prints", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * len(schema), schema)], schema=schema)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _emit_reps(key: bytes, buckets: int, docs: pa.Table) -> pa.Table:
    """Step 1 in a block: its distinct representatives, and whether two of its documents have each."""
    return _table(_REPS, Block(docs, key, buckets).emit_reps())


def _share_reps(new: pa.Table, runs: pa.Table) -> pa.Table:
    """Step 1 in a bucket: a bit for each representative of each block, set if a run or two documents have it."""
    if not new.num_rows:
        return _table(_BACK, [])
    each = [_unpack6(x) for x in new["reps"].to_pylist()]
    several = [_bits(x, len(e)) for x, e in zip(new["several"].to_pylist(), each)]
    every = np.sort(np.concatenate(each), kind="stable")
    twice = every[1:][every[1:] == every[:-1]]
    old = [_unpack6(x) for x in runs["reps"].to_pylist()]
    rows = []
    for block, bucket, rep, hit in zip(new["block"].to_pylist(), new["bucket"].to_pylist(), each, several):
        hit = hit | _is_in(rep, twice)
        for run in old:
            hit |= _is_in(rep, run)
        if hit.any():
            rows.append((block, 0, bucket, np.packbits(hit).tobytes()))
    return _table(_BACK, rows)


def _emit_prints(key: bytes, buckets: int, docs: pa.Table, back: pa.Table) -> pa.Table:
    """Step 2 in a block: fingerprints of its candidate windows."""
    if not docs.num_rows or not back.num_rows:
        return _table(_PRINTS, [])
    block = Block(docs, key, buckets)
    c = Candidates(block, back)
    return _table(_PRINTS, [(int(c.bucket[a]), block.number, c.fp[a:b].astype("<u8").tobytes(), _pack_ids(c.doc[a:b])) for a, b in _cuts(c.bucket)])


def _own_prints(new: pa.Table, runs: pa.Table) -> pa.Table:
    """Step 2 in a bucket: a bit for each candidate of each block, set if its document owns the window."""
    if not new.num_rows:
        return _table(_BACK, [])
    each = [_u8(x) for x in new["prints"].to_pylist()]
    fp, doc = np.concatenate(each), np.concatenate([_unpack_ids(x) for x in new["docs"].to_pylist()])
    order = np.lexsort((doc, fp))
    first = np.array([a for a, _ in _cuts(fp[order])])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(fp))))
    distinct, least = fp[order[first]], doc[order[first]]
    free = np.ones(len(distinct), bool)
    for run in runs["prints"].to_pylist():  # what a run has is older than the batch
        free &= ~_is_in(distinct, _u8(run))
    owner = np.empty(len(fp), bool)
    owner[order] = free[group] & (doc[order] == least[group])
    ends = np.cumsum([len(x) for x in each])
    return _table(_BACK, [(block, 1, bucket, np.packbits(owner[e - len(x) : e]).tobytes()) for block, bucket, x, e in zip(new["block"].to_pylist(), new["bucket"].to_pylist(), each, ends)])


def _apply(key: bytes, buckets: int, digest: bool, add: bool, names: list[str], docs: pa.Table, back: pa.Table) -> pa.Table:
    """Step 3 in a block, a row for each document; step 4 (if add), a row for each bucket with windows it owns."""
    if not docs.num_rows:
        return _joined([], [], [], [], names, docs, _table(_RUNS, []))
    block = Block(docs, key, buckets)
    c = Candidates(block, back)
    gone = np.zeros(len(block.start), bool)
    gone[c.windows] = ~block.answered(back, 1, c.bucket)[c.group] | (block.doc[c.windows] > c.doc[c.group])
    change = np.zeros(int(block.n_words.sum()) + 1, np.int64)
    np.add.at(change, block.start[gone], 1)
    np.add.at(change, block.start[gone] + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    n_removed, kept = [], []
    for data, first, n, text in zip(block.texts, block.first.tolist(), block.n_words.tolist(), block.rows["text"].to_pylist()):
        out = covered[first : first + n]
        n_removed.append(int(out.sum()))
        left = b" ".join(w for w, o in zip(data.split(), out.tolist()) if not o) if n_removed[-1] else b" ".join(data.split()) if digest else None
        kept.append(shared.sha(left) if digest else left.decode() if left is not None else text)
    run = _run_rows(block, ~gone) if add else _table(_RUNS, [])
    return _joined(block.ids, block.n_words.tolist(), n_removed, kept, names, block.rows, run)


def _run_rows(block: Block, own: np.ndarray) -> pa.Table:
    """Representatives and fingerprints of the windows that a block owns."""
    fp, bucket = block.prints(np.flatnonzero(own))
    order = np.lexsort((fp, bucket))
    fp, bucket = fp[order], bucket[order]
    prints = {int(bucket[a]): _merged([fp[a:b]]).astype("<u8").tobytes() for a, b in _cuts(bucket)}
    mine = np.zeros(len(block.rep), bool)
    mine[block.of_rep[own]] = True
    rep, at = block.rep[mine], block.rep_bucket[mine]
    reps = {int(at[a]): _pack6(rep[a:b]) for a, b in _cuts(at)}
    return _table(_RUNS, [(k, reps.get(k), prints.get(k)) for k in sorted({*reps, *prints})])


def _joined(ids: list, n_words: list, n_removed: list, kept: list, names: list[str], docs: pa.Table, run: pa.Table) -> pa.Table:
    """Rows of documents (part 0), then rows of the run (part 1; the columns of documents are null)."""
    n, m = len(ids), run.num_rows
    out = {k: pa.array([*v, *[None] * m], t) for k, v, t in (("doc_id", ids, pa.int64()), ("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept", kept, pa.string()))}
    out |= {f.name: pa.array([*[None] * n, *run[f.name].to_pylist()], f.type) for f in _RUNS}
    out |= {c: pa.concat_arrays([*docs[c].chunks, pa.nulls(m, docs[c].type)]) for c in names}
    return pa.table(out | {"part": pa.array([0] * n + [1] * m, pa.int32())})


def _merge_runs(rows: pa.Table) -> pa.Table:
    """One bucket's rows of several runs, or of several blocks of a batch, as one."""
    reps, prints = _merged([_unpack6(x) for x in rows["reps"].to_pylist()]), _merged([_u8(x) for x in rows["prints"].to_pylist()])
    return _table(_RUNS, [(rows["bucket"][0].as_py(), _pack6(reps), prints.astype("<u8").tobytes())])


class Index:
    """Sorted runs of window fingerprints in a folder, and the manifest that names them.

    The manifest is a table to which each change appends a version: a row for each run there is then. What it
    doesn't name was never finished, and is not read.
    """

    _MANIFEST = "version long, buckets long, key string, level int, run string"

    def __init__(self, spark: SparkSession, path: str, buckets: int, key: bytes, version: int, runs: list[tuple[int, str]]):
        self.spark, self.path, self.buckets, self.key, self.version, self.runs = spark, path, buckets, key, version, runs

    @classmethod
    def create(cls, spark: SparkSession, buckets: int, path: str | None = None) -> Index:
        """An empty index; buckets: how many ranges of hashes, about one for each BUCKET_BYTES that are to come."""
        new = cls(spark, path or shared.table_path(spark, "op3-index"), buckets, secrets.token_bytes(16), 0, [])
        new._commit([])
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.schema(cls._MANIFEST).parquet(f"{path}/manifest")
        now = rows.join(rows.agg(F.max("version").alias("version")), "version").collect()  # a row for each run
        return cls(spark, path, now[0].buckets, bytes.fromhex(now[0].key), now[0].version, sorted((r.level, r.run) for r in now if r.run is not None))

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        self.version += 1
        rows = [(self.version, self.buckets, self.key.hex(), level, run) for level, run in runs or [(None, None)]]
        self.spark.createDataFrame(rows, self._MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        self.runs = runs

    def _folder(self, run: str) -> str:
        return f"{self.path}/{run}"

    def read(self, runs: list[str] | None = None) -> DataFrame:
        names = [r for _, r in self.runs] if runs is None else runs
        if not names:
            return self.spark.createDataFrame([], _sql(_RUNS))
        return self.spark.read.schema(_sql(_RUNS)).parquet(*map(self._folder, names))

    def _write_run(self, rows: DataFrame, name: str) -> None:
        # Packed hashes hardly shrink, so no time goes into compressing them.
        with shared.transient_shuffles(self.spark):
            rows.groupBy("bucket").applyInArrow(shared.lean_group(_merge_runs), _sql(_RUNS)).write.mode("overwrite").option("compression", "none").parquet(self._folder(name))

    def add(self, rows: DataFrame) -> None:
        """Make a batch's rows a run of level 0; then merge levels that have FAN_OUT runs."""
        name = f"run-{self.version + 1}"
        self._write_run(rows, name)
        self._commit([*self.runs, (0, name)])
        while full := [k for k in {k for k, _ in self.runs} if sum(k == x for x, _ in self.runs) >= FAN_OUT]:
            self.compact(min(full))

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one of the next, then free the space of the old ones."""
        old, name = [r for k, r in self.runs if k == level], f"run-{self.version + 1}"
        self._write_run(self.read(old), name)
        self._commit([*(x for x in self.runs if x[0] != level), (level + 1, name)])
        shared.emptied(self.spark, *map(self._folder, old))

    def drop(self) -> None:
        """Free the space of all runs; the index is then empty."""
        old = [r for _, r in self.runs]
        self._commit([])
        shared.emptied(self.spark, *map(self._folder, old))


def dedup_batch(batch: DataFrame, index: Index, blocks: int, digest: bool = False, add: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text or its SHA-256) and the columns of the batch as c_<position>.

    The rows are written to the shared folder. With add the batch's windows become a run of the index.
    """
    spark, n, key = batch.sparkSession, index.buckets, index.key
    carried = {} if digest else {f"c_{k}": (c, t) for k, (c, t) in enumerate(batch.dtypes) if c != "text"}
    more, names = [F.col(f"`{c}`").alias(k) for k, (c, _) in carried.items()], list(carried)
    docs = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    dealt, runs = docs.groupBy("block"), index.read()
    reps = dealt.applyInArrow(shared.lean_group(lambda t: _emit_reps(key, n, t)), _sql(_REPS))
    back = reps.groupBy("bucket").cogroup(runs.select("bucket", "reps").groupBy("bucket")).applyInArrow(shared.lean_group(_share_reps), _sql(_BACK))
    prints = dealt.cogroup(back.groupBy("block")).applyInArrow(shared.lean_group(lambda a, b: _emit_prints(key, n, a, b)), _sql(_PRINTS))
    owners = prints.groupBy("bucket").cogroup(runs.select("bucket", "prints").groupBy("bucket")).applyInArrow(shared.lean_group(_own_prints), _sql(_BACK))
    answers = back.unionByName(owners).groupBy("block")
    schema = f"doc_id long, n_words long, n_removed long, kept string, {_sql(_RUNS)}" + "".join(f", {k} {t}" for k, (_, t) in carried.items()) + ", part int"
    out = dealt.cogroup(answers).applyInArrow(shared.lean_group(lambda a, b: _apply(key, n, digest, add, names, a, b)), schema)
    path = shared.table_path(spark, "op3-batch")
    with shared.transient_shuffles(spark):
        out.write.partitionBy("part").option("compression", "zstd").parquet(path)
    if add:
        index.add(spark.read.schema(schema).parquet(path).filter("part = 1").select("bucket", "reps", "prints"))
        shared.emptied(spark, f"{path}/part=1")
    return spark.read.schema(schema).parquet(path).filter("part = 0").drop("bucket", "reps", "prints", "part")


def dedup(docs: DataFrame, batches: int = BATCHES, digest: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, index: Index | None = None) -> DataFrame:
    """All of docs in batches of rising doc_id, as dedup_batch gives it.

    With an index, docs are newer than what it holds, and all of them are added. Without one, a temporary one is
    made, to which the last batch isn't added, as nothing follows it.
    """
    spark = docs.sparkSession
    size = shared.text_bytes(docs)
    own = index or Index.create(spark, shared.parts(size, bucket_bytes))
    i = F.col("doc_id").cast("long")
    shares = [0.5 ** (batches - k) for k in range(1, batches)]
    cuts = sorted({int(x) for x in docs.select(i.alias("doc_id")).approxQuantile("doc_id", shares, 0.001)}) if shares else []
    out = None
    for k in range(len(cuts) + 1):
        above = i >= cuts[k - 1] if k else F.lit(True)
        below = i < cuts[k] if k < len(cuts) else F.lit(True)
        part = docs.filter(above & below) if k else docs.filter(below | i.isNull())
        blocks = shared.parts(int(size * (shares[0] if k == 0 else 0.5 ** (len(cuts) - k + 1)) if cuts else size), block_bytes)
        done = dedup_batch(part, own, blocks, digest, add=index is not None or k < len(cuts))
        out = done if out is None else out.unionByName(done)
    if index is None:
        own.drop()
    return out


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs without repeated passages; a changed text is its kept words joined by one space, n_chars follows."""
    out, columns = dedup(docs, **options), []
    for k, (c, kind) in enumerate(docs.dtypes):
        if c == "text":
            column = F.col("kept").cast(kind)
        elif c == "n_chars":
            column = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(kind)).otherwise(F.col(f"c_{k}"))
        else:
            column = F.col(f"c_{k}")
        columns.append(column.alias(c))
    return out.select(*columns)
