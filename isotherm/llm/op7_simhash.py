"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits agree in at least 5 positional
bytes, so such a pair meets in one of eight posting lists: the positions are halved, and any 5 of 8 positions
hold 3 of one half, hence one of the 4 + 4 triples of positions within the halves. A list is keyed by a
triple and its three bytes. For the pairs that meet, equal bytes are tallied position by position, pairs below the
guaranteed minimum of 5 are dropped, and only the rest are verified by their differing bits.

Lists keyed by single bytes, the textbook form, hold a 256th of all documents each and make the work grow
with the square of the corpus at any size; triples keep the method and its exactness with 16.7 million lists
for each of eight triples.

Scale: copies are folded to distinct fingerprints first (map-side combined). A list never emits its pairs,
only a spanning forest of its links. A list of more than ``LIST_LIMIT`` fingerprints is dealt anew by five
positional bytes (56 choices, of which a fingerprint takes those that hold a long list's three): such a list holds
at most 2**24 values, and beyond the limit it is searched by flipping at most 3 of its 24 free bits, which is linear in its length.
Components are found by alternating large-star and small-star steps, all in tables. Fingerprints that very many rows
share (those of empty texts, say) get their component by a broadcast of at most ``HOT_MOST`` rows, the rest by a join.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; rows
with the same doc_id are separate rows with one id; a null doc_id is never the smallest, a component of only
such rows has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHINGLE, SEED, MAX_BITS, MIN_BYTES = 3, 42, 3, 5
LIST_LIMIT = 4096
#: A fingerprint is hot if more rows than this have it, and more than the share of all rows that allows HOT_MOST of them.
HOT_ROWS, HOT_MOST = 100_000, 10_000
#: Names of long lists (12 bytes each) are broadcast up to this number, else joined.
BROADCAST_LISTS = 500_000
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Any five of eight positions: three of them are in one half.
FIVES = [*combinations(range(8), 5)]


def fingerprint(text: str | None) -> int:
    """SimHash over lower-cased 3-word shingles, repeats included, as an unsigned integer."""
    words = shared.utf8(text).translate(shared.ASCII_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    starts = [0, *(np.cumsum([len(w) for w in words[:-1]]) + np.arange(1, len(words))).tolist()]
    ends = [*(s - 1 for s in starts[SHINGLE:]), len(joined)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["content"], pa.array(fp, pa.int64())], ["doc_id", "content", "fp"])


def _content():
    """A text's hash, by which a row is known beside its doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("content")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, content, fp) of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _content())
    return slim.mapInArrow(shared.lean(_fingerprints), "doc_id long, content long, fp long")


def _key(number: int, positions: tuple[int, ...]):
    """A list's key: which positions, and the bytes in them (bytes of the other positions are zero)."""
    mask = sum(0xFF << (8 * p) for p in positions)
    return F.struct(F.lit(number).cast("short").alias("at"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bytes"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each element's component under links a-b of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(fp: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) among the fingerprints of one list, a block of them with all later ones at a time.

    Equal bytes are tallied position by position; positions that the whole list shares count for all. Only pairs
    that reach MIN_BYTES are looked at as fingerprints.
    """
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    by = np.ascontiguousarray(fp.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    differ = [p for p in range(8) if (by[p] != by[p, :1]).any()]
    for at in range(0, len(fp), block):
        tally = np.zeros((min(block, len(fp) - at), len(fp) - at), np.uint8)
        for p in differ:
            tally += by[p, at : at + block, None] == by[p, None, at:]
        a, b = np.nonzero(tally >= MIN_BYTES - (8 - len(differ)))
        a, b = a[a < b] + at, b[a < b] + at
        near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
        out_a.append(a[near])
        out_b.append(b[near])
    return np.concatenate(out_a), np.concatenate(out_b)


def _flips(free: list[int]) -> np.ndarray:
    bits = [1 << (8 * p + i) for p in free for i in range(8)]
    return np.array([sum(c) for k in range(1, MAX_BITS + 1) for c in combinations(bits, k)], np.uint64)


def links_by_flips(fp: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for sorted fingerprints that agree outside the free byte positions: look up each neighbour."""
    out_a, out_b = [], []
    for f in _flips(free):
        want = fp ^ f
        at = np.searchsorted(fp, want)
        at[at == len(fp)] = 0
        hit = np.flatnonzero((fp[at] == want) & (fp < want))
        out_a.append(hit)
        out_b.append(at[hit])
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(fp: np.ndarray, limit: int = LIST_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one list's links: (smallest member, member) of each linked fingerprint."""
    fp = np.unique(fp)
    if len(fp) <= limit:
        a, b = links(fp)
    else:
        differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
        a, b = links_by_flips(fp, [p for p in range(8) if differ >> (8 * p) & 0xFF])
    root = _roots(len(fp), a, b)
    member = np.flatnonzero(root != np.arange(len(fp)))
    return fp[root[member]], fp[member]


def _forests(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list; a list may go on in the next batch."""
    held: list[np.ndarray] = []
    held_key = None

    def emit(groups):
        found = [forest(g, limit) for g in groups]
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.uint64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        at, own, fp = (batch[c].to_numpy(zero_copy_only=False) for c in ("at", "bytes", "fp"))
        fp = fp.view(np.uint64)
        if not len(fp):
            continue
        cuts = np.concatenate(([0], np.flatnonzero((at[1:] != at[:-1]) | (own[1:] != own[:-1])) + 1, [len(fp)]))
        done = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if (key := (at[lo], own[lo])) == held_key:
                held.append(fp[lo:hi])
                continue
            if sum(map(len, held)) > 1:
                done.append(np.concatenate(held))
            held, held_key = [fp[lo:hi].copy()], key
        yield emit(done)
    if sum(map(len, held)) > 1:
        yield emit([np.concatenate(held)])


def _linked(postings: DataFrame, limit: int) -> DataFrame:
    sort = postings.select("key.at", "key.bytes", "fp").repartition("at", "bytes").sortWithinPartitions("at", "bytes")
    return sort.mapInArrow(shared.lean(lambda it: _forests(limit, it)), "a long, b long")


def edges(distinct: DataFrame, scratch: shared.Scratch, limit: int = LIST_LIMIT) -> DataFrame:
    """Links (a, b) that connect what is connected; at most eight for each fingerprint of a list."""
    postings = distinct.select(F.explode(F.array(*(_key(k, p) for k, p in enumerate(TRIPLES)))).alias("key"), "fp")
    long_lists = scratch.written(postings.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key"), "op7-lists")
    if not (n_long := long_lists.count()):
        return _linked(postings, limit)
    names = F.broadcast(long_lists) if n_long <= BROADCAST_LISTS else long_lists
    usual = _linked(postings.join(names, "key", "left_anti"), limit)
    # Five positions hold several triples: a fingerprint goes to a list of five once, whichever of its triples are long.
    of = postings.join(names, "key", "left_semi").groupBy("fp").agg(F.collect_set("key.at").alias("long"))
    fives = [
        F.when(F.arrays_overlap("long", F.array(*(F.lit(k).cast("short") for k, t in enumerate(TRIPLES) if set(t) <= set(five)))), _key(len(TRIPLES) + i, five))
        for i, five in enumerate(FIVES)
    ]
    again = of.select(F.explode(F.array_compact(F.array(*fives))).alias("key"), "fp")
    return usual.unionByName(_linked(again, limit))


def stars(links_: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(node, root): each linked node with the smallest node of its component.

    Large-star gives a node's larger neighbours its smallest neighbour, small-star its smaller ones; repeated
    until nothing changes, that leaves a star on the smallest node. Each round is written to the shared folder. A node
    of very many links is joined by broadcast (``shared.joined``), so the hub of a large component isn't one task's.
    """
    now = scratch.written(links_.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "op7-edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = shared.joined(both.filter("v > u"), low, ["u"], "n", rows=2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = scratch.written(large, "op7-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = shared.joined(large, low, ["u"], "n", rows=2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", "m")).distinct()
        now = scratch.written(small, "op7-edges")
        if (new := _state(now)) == state:
            break
        state = new
    return now.toDF("node", "root")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())


def _rooted(marked: DataFrame, scratch: shared.Scratch, limit: int = LIST_LIMIT) -> DataFrame:
    """(fp, n, first, root) of each distinct fingerprint of marked (doc_id, content, fp).

    n: rows that have it; first: the smallest (no id, doc_id, content) of them; root: of its component.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")).alias("first")  # null comes last
    nodes = scratch.written(marked.groupBy("fp").agg(F.count("*").alias("n"), first), "op7-nodes")
    star = stars(edges(nodes.select("fp"), scratch, limit), scratch)
    return nodes.join(star.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))


def components(marked: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """(fp, n, component_id) of each distinct fingerprint of marked (doc_id, content, fp)."""
    with shared.Scratch(marked.sparkSession) as scratch:
        rooted = _rooted(marked, scratch, limit)
        least = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
        return shared.written(rooted.join(least, "root").select("fp", "n", "component_id"), "op7-components")


def near_duplicates(docs: DataFrame, hot_rows: int = HOT_ROWS, limit: int = LIST_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row; limit: longer lists are dealt anew."""
    marked = shared.written(fingerprints(docs), "op7-fingerprints")
    of = components(marked, limit)
    rows = of.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(hot_rows, rows // HOT_MOST)
    few = F.broadcast(of.filter(hot).drop("n"))
    usual = marked.join(few.select("fp"), "fp", "left_anti").join(of.filter(~hot).drop("n"), "fp")
    every = usual.unionByName(marked.join(few, "fp"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _chosen(rooted: DataFrame) -> DataFrame:
    """(i, isn, content) of the one row of each component that stays: its doc_id or -1, whether that is null, its text."""
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return first.select(F.coalesce("first.doc_id", F.lit(-1)).alias("i"), F.col("first.none").alias("isn"), F.col("first.content").alias("content"))


def keep(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with the columns of docs.

    If several texts share that id, or all ids are null, it is that with the smallest hash of its text. Among
    repeated rows of that id and text one stays. Texts are shuffled once, to meet the ids that are kept.
    """
    with shared.Scratch(docs.sparkSession) as scratch:
        rooted = _rooted(scratch.written(fingerprints(docs), "op7-fingerprints"), scratch)
        chosen = shared.written(_chosen(rooted), "op7-chosen")
    # A null id is kept only in a component of null ids; -1 stands for it beside a flag, so the join is an equi-join.
    carried = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(docs.columns)]
    own = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(own, F.lit(-1)).alias("i"), own.isNull().alias("isn"), _content(), *carried)
    key = ["i", "isn", "content"]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    once = rows.join(chosen, key, "left_semi").withColumn("n", n).filter("n = 1")
    return once.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))
