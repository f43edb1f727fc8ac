"""Quality rules: frequency of lines over the documents of a host.

Method: every line is normalised (A-Z lower-cased, words joined by one space) and hashed. For each host the
distinct documents of each line are counted: all documents of the host, those that fail the base rules too, each known
by its doc_id and text. A line found in more documents of its host than the limit allows is removed from all of them
but the first (the smallest doc_id); a document of whose words too few are left is rejected, and so is one that fails
the base rules. Copies count, so that of a text with more copies than the limit the first stays.

Scale: counts are sums by (host, line hash) with map-side aggregation, so neither a hot host nor a line that
a third of all documents share lands in one task. Lines above the limit are broadcast while their number is below
``BROADCAST_LINES``, else joined, with the same result: lines of very many documents by broadcast (a bounded
number of them, see ``shared.joined``), the others by a shuffle.

Defined cases: null text is empty; null host is a host of its own; empty lines are not counted; rows with the
same doc_id and text are one document; a null doc_id counts, and is never the first one; an empty table gives
an empty result; other columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: A line is frequent if more distinct documents of its host than MIN_DOCS have it, and more than this share of them,
#: so that on a host of a million documents it takes a thousand.
MIN_DOCS, MAX_SHARE = 10, 0.001
#: A document is depleted if a smaller share of its words is left.
MIN_LEFT = 0.50
#: Base limits: fewest words, largest share (percent) of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT = 50, 50
#: More frequent lines than these (16 bytes each, 3.2 MB) are joined, not broadcast.
BROADCAST_LINES = 200_000

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_CONTINUATION = bytes(range(0x80, 0xC0))

_METRICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_key(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words).translate(shared.ASCII_LOWER)))


def text_key(data: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(data))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that the list holds at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def base_rules(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of one text."""
    data = shared.utf8(text)
    words = data.split()
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n, repeat = len(words), repeated_words(words)
    symbols = len(_SYMBOLS.findall(text)) if text else 0
    return n, chars, symbols, len(lines) - len(set(lines)), repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT * n


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, keys, texts, ids, words = [], [], [], [], []
        for i, host, text in zip(b["doc_id"].to_pylist(), b["host"].to_pylist(), b["text"].to_pylist()):
            data = shared.utf8(text)
            of, seen = text_key(data), Counter()
            for line in data.split(b"\n"):
                if w := line.split():
                    seen[line_key(w)] += len(w)
            hosts += [host] * len(seen)
            keys += seen.keys()
            words += seen.values()
            texts += [of] * len(seen)
            ids += [i] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(texts, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.int64())], ["host", "line", "content", "doc_id", "words"])


def line_rows(docs: DataFrame, host: str) -> DataFrame:
    """(host, line, content, doc_id, words): one row for each distinct line of each document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(shared.lean(_line_rows), "host string, line long, content long, doc_id long, words long")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, first_doc, n_docs) of lines above the limits. Exact counts over all documents.

    Rows of equal doc_id and text are folded first, which also spreads a hot line over the documents that have it.
    """
    each = line_rows(docs, host).groupBy("host", "line", "content", "doc_id").agg(F.lit(1).alias("one"))
    lines = each.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") > min_docs)
    if not max_share:
        return lines.select("host", "line", "first_doc", "n_docs")
    content = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    every = docs.select(F.col(host).cast("string").alias("host"), F.col("doc_id").cast("long").alias("doc_id"), content.alias("content")).distinct()
    sizes = every.groupBy("host").agg(F.count("*").alias("host_docs"))
    return lines.alias("l").join(sizes.alias("s"), F.col("l.host").eqNullSafe(F.col("s.host"))).filter(F.col("n_docs") > max_share * F.col("host_docs")).select("l.host", "line", "first_doc", "n_docs")


def _judge(sent, with_text: bool, with_key: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frequent: dict[tuple[str | None, int], int | None] = sent.value
    hosts = {h for h, _ in frequent}
    for b in batches:
        rows = []
        for i, host, text in zip(b["doc_id"].to_pylist(), b["host"].to_pylist(), b["text"].to_pylist()):
            base, removed = base_rules(text), 0
            if host in hosts:
                for line in shared.utf8(text).split(b"\n"):
                    if (w := line.split()) and (key := (host, line_key(w))) in frequent and (i is None or i != frequent[key]):
                        removed += len(w)
            rows.append((i, *base, removed))
        columns = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words"]
        if with_text:
            arrays, names = [*arrays, *(b.column(c) for c in b.schema.names if c[:2] == "c_")], [*names, *(c for c in b.schema.names if c[:2] == "c_")]
        if with_key:
            contents = [text_key(shared.utf8(t)) for t in b["text"].to_pylist()]
            arrays, names = [*arrays, b["host"], pa.array(contents, pa.int64())], [*names, "host", "content"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def judge(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, broadcast_lines: int = BROADCAST_LINES, carry: bool = False, hot_docs: int | None = None) -> DataFrame:
    """One row for each row of docs: the base figures, base_failed, removed_words and kept.

    carry: also return the columns of docs, each as c_<position>. hot_docs: frequent lines of more documents, at the
    least, aren't shuffled where lines are too many to be broadcast.
    """
    spark = docs.sparkSession
    path = shared.table_path(spark, "op6-lines")
    frequent = shared.written(frequent_lines(docs, host, min_docs, max_share), "op6-lines", path)
    slim = [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")]
    more = [F.col(f"`{c}`").alias(f"c_{k}") for k, c in enumerate(docs.columns)] if carry else []
    schema = _METRICS + ", removed_words long" + "".join(f", c_{k} {t}" for k, (_, t) in enumerate(docs.dtypes) if carry)
    few = frequent.limit(broadcast_lines + 1).count() <= broadcast_lines  # a check of size, not a cap: more go the other way
    table = spark.sparkContext.broadcast({(r["host"], r["line"]): r["first_doc"] for r in frequent.toLocalIterator()} if few else {})
    if few:
        shared.emptied(spark, path)
    keyed = "" if few else ", host string, content long"
    out = docs.select(*slim, *more).mapInArrow(shared.lean(lambda it: _judge(table, carry, not few, it)), schema + keyed)
    if not few:
        # A row is known by host, content and doc_id, null or not, as in the table; equal rows share what is gone.
        key, named = ["doc_id", "host", "content"], [F.coalesce("host", F.lit("")).alias("named"), F.col("host").isNull().alias("nameless"), "line"]
        lines = frequent.select(*named, "first_doc", "n_docs")
        hit = shared.joined(line_rows(docs, host).select("*", *named[:2]), lines, ["named", "nameless", "line"], "n_docs", rows=frequent.agg(F.sum("n_docs")).first()[0] or 0, least=hot_docs)
        gone = (
            hit.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select(*key, "line", "words").distinct().groupBy(*key).agg(F.sum("words").alias("gone"))
            .select(*(F.col(k).alias(f"of_{k}") for k in key), "gone")
        )
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
        out = out.join(gone, same, "left").withColumn("removed_words", F.coalesce("gone", F.lit(0).cast("long"))).drop("gone", "host", "content", *(f"of_{k}" for k in key))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    judged = judge(docs, carry=True, **options).filter("kept")
    return judged.select(*(F.col(f"c_{k}").alias(c) for k, c in enumerate(docs.columns)))
