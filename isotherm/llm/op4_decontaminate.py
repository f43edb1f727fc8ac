"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of 13 consecutive words of each benchmark item (an item of fewer words is one
window). The search looks at the block of the last B words of the current position: the shift table tells how
far the position may move without missing a window; where the shift is zero, the block names the bucket of
windows that end in it, and each of them is compared with the text directly. Windows of different lengths
have tables of their own (13 lengths at most), so a short item doesn't shorten the shifts of the rest. Words are
numbered, and all tables are flat arrays.

Scale: documents are only scanned; nothing of them is shuffled. The benchmark is a query set. Equal rows of it count
once; it is broken into blocks of at most ``BLOCK_WINDOWS`` windows and about ``BLOCK_BYTES`` of text, an item of very many
windows into parts, and each block is collected and broadcast for one scan. As long as it fits
into one block (measured first) there is one scan and no shuffle, else each block's hits are written before the next
block is made, its broadcast is dropped, and the hits of all blocks are merged by document.

Defined cases: null text has no words; a null item_id has no name and is left out of items, but its windows
hit; rows of one item_id are one item with several texts; a repeated document row gives a row each (merged
by row, not by id, when there are several blocks); empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WINDOW = 13
BLOCK_WORDS = 3
#: Windows of the benchmark that are collected and broadcast at once, and bytes of its text (a megabyte more at most).
BLOCK_WINDOWS, BLOCK_BYTES = 1 << 20, 16 << 20
_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


#: Bits of a word's number in the key of a block of words; a benchmark block has fewer different words than that.
_BITS = 21


def _keys(words: np.ndarray, b: int) -> np.ndarray:
    """Key of the block of b words that ends at each place from b - 1 on; a stranger (-1) makes it -1."""
    n = len(words) - b + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(b):
        part = words[k : k + n]
        out = out << _BITS | part
        known &= part >= 0
    return np.where(known, out, -1)


def _held(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of x is in a sorted array, and whether it is there at all."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(sorted_, x)
    at[at == len(sorted_)] = 0
    return at, sorted_[at] == x


class WuManber:
    """Finds all occurrences of patterns of one length (in words), given as places in a text of word numbers.

    Flat arrays hold everything: sorted keys of blocks with their shifts, the patterns sorted by their last block, and
    for each of them the items it is from.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, items: np.ndarray, m: int):
        self.m, self.flat, self.b = m, flat.astype("<i4").tobytes(), min(BLOCK_WORDS, m)
        self.default = m - self.b + 1
        whole = np.ascontiguousarray(flat[starts[:, None] + np.arange(m)]).view(np.dtype((np.void, 4 * m))).ravel()
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
        own = starts[first]
        keys = _keys(flat, self.b)  # by the place where a block begins
        last = keys[own + m - self.b]
        order = np.argsort(last, kind="stable")
        self.starts, self.suffixes = own[order], last[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[of], items], 1)[items >= 0], axis=0)
        self.items, self.item_at = pairs[:, 1].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(own) + 1))
        # From the smallest shift up: a block keeps the first one it gets.
        self.blocks, self.shifts = np.empty(0, np.int64), np.empty(0, np.int16)
        for shift in range(m - self.b + 1):
            new = np.unique(keys[own + m - self.b - shift])
            new = new[~_held(self.blocks, new)[1]]
            blocks = np.concatenate((self.blocks, new))
            by = np.argsort(blocks, kind="stable")
            self.blocks, self.shifts = blocks[by], np.concatenate((self.shifts, np.full(len(new), shift, np.int16)))[by]

    def search(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(start, items) of each occurrence in a text of word numbers, by start."""
        m, b, n = self.m, self.b, len(words)
        if n < m:
            return
        keys = _keys(words, b)
        at, held = _held(self.blocks, keys)
        step = np.where(held, self.shifts[at], self.default).tolist()
        raw, i = words.astype("<i4").tobytes(), m
        while i <= n:
            if move := step[i - b]:
                i += move
                continue
            text, key = raw[4 * (i - m) : 4 * i], keys[i - b]
            for k in range(*np.searchsorted(self.suffixes, [key, key + 1]).tolist()):
                s = 4 * int(self.starts[k])
                if self.flat[s : s + 4 * m] == text:
                    yield i - m, self.items[self.item_at[k] : self.item_at[k + 1]]
                    break  # patterns differ
            i += 1


class Index:
    """All windows of a block of items, by length: rows of (item, text), or of (item, text, first window, last window)."""

    def __init__(self, rows: list[tuple], window: int = WINDOW):
        self.names = sorted({r[0] for r in rows if r[0] is not None})
        place = {i: k for k, i in enumerate(self.names)}
        self.words: dict[bytes, int] = {}
        flat, starts, items, at = [], {}, {}, 0
        for item, text, *part in rows:
            words = shared.alnum_words(text)
            lo, hi = part or (0, max(0, len(words) - window))
            words = words[lo : hi + window]
            if not words:
                continue
            own, m = [self.words.setdefault(w, len(self.words)) for w in words], min(window, len(words))
            flat.append(np.array(own, np.int32))
            n = len(own) - m + 1
            starts.setdefault(m, []).append(np.arange(at, at + n))
            items.setdefault(m, []).append(np.full(n, -1 if item is None else place[item]))
            at += len(own)
        if len(self.words) >> _BITS:
            raise ValueError("too many different words in one block of the benchmark")
        text = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.searches = [WuManber(text, np.concatenate(starts[m]), np.concatenate(items[m]), m) for m in sorted(starts)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        of = self.words.get
        return np.array([of(w, -1) for w in words], np.int64)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Spans [start, end) of words inside occurrences, disjoint and sorted, and the items found."""
        spans, items = [], set()
        numbers = self.numbers(words)
        for s in self.searches:
            for start, of in s.search(numbers):
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], start + s.m))
                else:
                    spans.append((start, start + s.m))
                items.update(of.tolist())
        return merged(spans), [self.names[k] for k in sorted(items)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _verdict(n: int, spans: list[tuple[int, int]], items: list[str]) -> tuple[int, int, int, str, bool]:
    hit = sum(b - a for a, b in spans)
    return n, hit, len(items), shared.sha(",".join(sorted(items)).encode()), hit > 0 and 20 * hit >= n


def _carried(b: pa.RecordBatch) -> tuple[list, list[str]]:
    names = [c for c in b.schema.names if c[:2] == "c_"]
    return [b.column(c) for c in names], names


def _direct(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
            words = shared.alnum_words(text)
            rows.append((i, *_verdict(len(words), *index.hits(words))))
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
        more, names = _carried(b)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + more, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *names])


def _spans(index: Index, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of one block of items; every: also a row for texts without any."""
    for b in batches:
        found = [(len(w), *index.hits(w)) for w in map(shared.alnum_words, b["text"].to_pylist())]
        out = pa.RecordBatch.from_arrays(
            [b["content"], pa.array([n for n, _, _ in found], pa.int64()), pa.array([[x for s in y for x in s] for _, y, _ in found], pa.list_(pa.int64())), pa.array([z for _, _, z in found], pa.list_(pa.string()))],
            ["content", "n", "spans", "items"],
        )
        yield out if every else out.filter(pa.array([bool(y) for _, y, _ in found], pa.bool_()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for n, spans, items in zip(b["n"].to_pylist(), b["spans"].to_pylist(), b["items"].to_pylist()):
            flat = [x for s in spans for x in zip(s[::2], s[1::2])]
            rows.append(_verdict(n, merged(flat), sorted({x for s in items for x in s})))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([b["content"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["content", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _dealt(bench: DataFrame, window: int, block_windows: int, block_bytes: int) -> DataFrame:
    """Distinct items with the windows from lo to hi that a block has of them, and the number of the block.

    An item of more windows than half a block is cut; prefix sums over windows and bytes deal the parts out.
    """
    each = max(1, block_windows // 2)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = F.greatest(F.lit(1), F.regexp_count(lower, F.lit(_WORDS)) - window + 1)
    items = bench.filter("text is not null").distinct().withColumn("n", n.cast("long"))
    parts = items.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(each).cast("long"))))
    parts = parts.withColumn("hi", F.least(F.col("lo") + each, F.col("n")) - 1).withColumn("h", F.xxhash64("item_id", "text", "lo"))
    size = (F.col("hi") - F.col("lo") + 1) / float(block_windows) + F.octet_length("text") * (F.col("hi") - F.col("lo") + 1) / F.col("n") / float(block_bytes)
    # Only names, numbers and sizes pass the one task that adds them up: the benchmark is a query set.
    sizes = parts.select("h", size.alias("size")).groupBy("h").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = sizes.select("h", F.floor(upto * 2).cast("int").alias("block"))
    return parts.join(blocks, "h").select("item_id", "text", "lo", "hi", "block")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row for each row of docs: n_words, n_hit, n_items, items_sha256, contaminated.

    carry: also return the columns of docs, each as c_<position>.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    path = shared.table_path(spark, "op4-benchmark")
    dealt = shared.written(_dealt(bench, window, block_windows, block_bytes), "op4-benchmark", path)
    last = dealt.agg(F.max("block")).first()[0]
    blocks = 1 if last is None else last + 1
    more = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(docs.columns)] if carry else []
    schema = _SCHEMA + "".join(f", c_{k} {t}" for k, (_, t) in enumerate(docs.dtypes) if carry)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)

    def index(k: int):
        rows = dealt.filter(F.col("block") == k).select("item_id", "text", "lo", "hi")
        return spark.sparkContext.broadcast(Index([tuple(r) for r in rows.toLocalIterator()], window))

    if blocks == 1:
        one = index(0)
        shared.emptied(spark, path)
        return slim.mapInArrow(shared.lean(lambda it: _direct(one.value, it)), schema)
    # Texts are keyed by 128 bits of their content, so repeated rows and ids need no care.
    content = F.concat_ws("-", F.xxhash64("text"), F.md5("text"))
    texts = slim.select("text").withColumn("content", content)
    scans = None
    for k in range(blocks):
        now = index(k)
        part = texts.mapInArrow(shared.lean(lambda it, now=now, k=k: _spans(now.value, k == 0, it)), "content string, n long, spans array<long>, items array<string>")
        part = shared.written(part, "op4-hits")
        now.destroy()
        scans = part if scans is None else scans.unionByName(part)
    shared.emptied(spark, path)
    by_text = scans.groupBy("content").agg(F.first("n").alias("n"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    verdicts = by_text.mapInArrow(shared.lean(_merge), "content string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    joined = slim.withColumn("content", content).drop("text").join(verdicts, "content", "left").drop("content")
    return joined.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(f"c_{k}" for k in range(len(more))))


def keep(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs."""
    judged = judge(docs, benchmark, carry=True, **options).filter(~F.col("contaminated"))
    return judged.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))
