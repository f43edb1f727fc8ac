"""URL filters by a cascade of Bloom filters.

Rules and listed hosts are keys, a host and the beginning of a path: ``example.org/es/``. The keys that could
fit some URL of the corpus (its host and parent domains, with the beginnings of its path of every length that
rules have) are the complete universe. The first Bloom filter encodes the listed keys that occur in the
universe; the second one the other keys of the universe that pass the first; the third one the listed keys
that pass the second; and so on until nothing passes wrongly. A key's membership is then exact for the whole
universe: it is listed if the first filter that rejects it is an even one. URLs are judged without a join.

There are two cascades, of what allows and of what blocks, and the longest key that is in one decides, the
smallest of equally long ones.

Scale: the universe is made by one distinct (map-side combined, so a hot host is one row a task) and marked
with the lists by one join. A level of all cascades is one job: bit_or over 64-bit words of the filters. The
first level scans the universe, later ones only what passed a first level and what is listed. Executors put ranges
of words together, so the driver gets a level as a few packed arrays and not word by word. A level's size
depends on the list and, by the choice of the first filter's error rate, hardly on the universe. It is set by
the expected number of keys; more keys than expected only make for more levels. Filters are broadcast while
they take at most ``MAX_FILTER_BYTES``; larger lists are looked up by a join instead, with the same result.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and the default
verdict; a rule with an empty host fits none; a rule in both lists blocks; repeated URLs are judged alike;
an empty table gives no rows, an empty list fits nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MAX_FILTER_BYTES = 64 << 20

#: The contract's rules.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of a filter that executors hand over in one row.
RANGE_WORDS = 1 << 16

#: Hosts that the method blocks where no rule fits.
LISTED_HOSTS = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))

_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL, as the contract has them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find(c) for c in "?#") if i >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_UPPER), path


def candidates(host: str, path: str, lengths: tuple[int, ...]) -> list[str]:
    """Keys that would fit, longest first; lengths: of the rules' paths, falling. A key of length 0 is a host."""
    if not host:
        return []
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    keys = [h + path[:n] for h in hosts if h for n in lengths if len(path) >= n]
    return sorted(keys, key=lambda k: (-len(k), k))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def places(self, key: str, seed: int) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "replace"), seed)
        a, b = (h & 0xFFFFFFFFFFFFFFFF) % self.bits, (h >> 64) % self.bits | 1
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def has(self, key: str, seed: int) -> bool:
        words = self.words
        return all(int(words[p >> 6]) >> (p & 63) & 1 for p in self.places(key, seed))


class Cascade:
    """number: tells cascades apart, so that they err on different keys."""

    def __init__(self, number: int, levels: list[Level] | None = None):
        self.number, self.levels = number, levels or []

    def seed(self, level: int) -> int:
        return 1000 * self.number + level

    def has(self, key: str, level: int) -> bool:
        return self.levels[level].has(key, self.seed(level))

    def __contains__(self, key: str) -> bool:
        for n in range(len(self.levels)):
            if not self.has(key, n):
                return n % 2 == 1
        return len(self.levels) % 2 == 1

    def wants(self, key: str, listed: bool) -> bool:
        """Whether the next level must encode a key: it is of the level's kind, and passed wrongly so far."""
        n = len(self.levels)
        return listed == (n % 2 == 0) and all(self.has(key, k) for k in range(1 - n % 2, n, 2))

    def size(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _shape(n: float, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, round(-math.log2(rate)))


def _set_bits(cascades: list[Cascade], shapes: dict[int, Level], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the next level of each cascade that goes on, ored within a batch."""
    for b in batches:
        words: dict[tuple[int, int], int] = {}
        for key, mask in zip(b["key"].to_pylist(), b["mask"].to_pylist()):
            for n, shape in shapes.items():
                c = cascades[n]
                if c.wants(key, bool(mask >> n & 1)):
                    for p in shape.places(key, c.seed(len(c.levels))):
                        words[n, p >> 6] = words.get((n, p >> 6), 0) | 1 << (p & 63)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in words], pa.int64()), pa.array([w for _, w in words], pa.int64()), pa.array(np.array(list(words.values()), np.uint64).view(np.int64))], ["cascade", "word", "bits"]
        )


def _packed(rows: pa.Table) -> pa.Table:
    """A range of words of a level as one array."""
    part = rows["part"][0].as_py()
    at = rows["word"].to_numpy() - part * RANGE_WORDS
    words = np.zeros(int(at.max()) + 1, np.int64)
    words[at] = rows["bits"].to_numpy()
    return pa.table({"cascade": rows["cascade"].slice(0, 1), "part": pa.array([part], pa.int64()), "words": pa.array([words.astype("<i8").tobytes()], pa.binary())})


def _suspects(cascades: list[Cascade], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that are listed somewhere, or pass the first level of a cascade."""
    for b in batches:
        keep = [m != 0 or any(c.levels and c.has(k, 0) for c in cascades) for k, m in zip(b["key"].to_pylist(), b["mask"].to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def build_cascades(universe: DataFrame, n_lists: int, max_bytes: int = MAX_FILTER_BYTES) -> list[Cascade] | None:
    """A cascade for each list; universe: (key, mask), bit n of mask set if list n has the key.

    None if the filters would take more than max_bytes.
    """
    with shared.Scratch(universe.sparkSession) as scratch:
        return _cascades(universe, n_lists, max_bytes, scratch)


def _cascades(universe: DataFrame, n_lists: int, max_bytes: int, scratch: shared.Scratch) -> list[Cascade] | None:
    cascades, rows = [Cascade(n) for n in range(n_lists)], universe
    sizes = {r["mask"]: r["n"] for r in universe.groupBy("mask").agg(F.count("*").alias("n")).collect()}  # 2**n_lists at most
    inside = [sum(n for m, n in sizes.items() if m >> k & 1) for k in range(n_lists)]
    outside = [sum(sizes.values()) - n for n in inside]
    # The first level lets about as many strangers pass as it holds keys; later ones half of what is left.
    rates = [min(0.5, i / (math.sqrt(2) * max(1, o))) if i else 0.5 for i, o in zip(inside, outside)]
    going, level = [n for n in range(n_lists) if inside[n]], 0
    while going:
        shapes = {}
        for n in going:
            expected = inside[n] * 0.5 ** (level / 2) if level % 2 == 0 else 1.1 * outside[n] * rates[n] * 0.5 ** ((level - 1) / 2)
            bits, hashes = _shape(expected, 0.5 if level else rates[n])
            shapes[n] = Level(bits, hashes, np.zeros(0, np.uint64))
        if sum(c.size() for c in cascades) + sum(x.bits // 8 for x in shapes.values()) > max_bytes:
            return None
        ored = rows.mapInArrow(lambda it, c=cascades, s=shapes: _set_bits(c, s, it), "cascade long, word long, bits long").groupBy("cascade", "word").agg(F.bit_or("bits").alias("bits"))
        ranges = ored.withColumn("part", F.floor(F.col("word") / RANGE_WORDS)).groupBy("cascade", "part").applyInArrow(_packed, "cascade long, part long, words binary")
        got = ranges.collect()  # the level's words, which max_bytes bounds
        going = sorted({r["cascade"] for r in got})
        for n in going:
            shapes[n].words = np.zeros(shapes[n].bits // 64, np.uint64)
        for r in got:
            words = np.frombuffer(r["words"], "<u8")
            shapes[r["cascade"]].words[r["part"] * RANGE_WORDS :][: len(words)] = words
        for n in going:
            cascades[n].levels.append(shapes[n])
        if not level and going:
            rows = scratch.written(universe.mapInArrow(shared.lean(lambda it, c=cascades: _suspects(c, it)), "key string, mask long"), "op9-suspects")
        level += 1
    return cascades


def _candidate_rows(lengths: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = {k for u in b["url"].to_pylist() for k in candidates(*split_url(u), lengths)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])


def _judge(sent, rules: tuple[int, ...], hosts: tuple[int, ...], default: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    allow, block, listed = sent.value
    for b in batches:
        out = []
        for u in b["url"].to_pylist():
            host, path = split_url(u)
            rule, verdict = next(((k, "block" if k in block else "allow") for k in candidates(host, path, rules) if k in block or k in allow), (None, None))
            if rule is None:
                verdict = "block" if any(k in listed for k in candidates(host, path, hosts)) else default
            out.append((host, path, rule, verdict))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([b["page_id"], *(pa.array(c, pa.string()) for c in columns)], ["page_id", "host", "path", "rule", "verdict"])


def _marked(scratch: shared.Scratch, slim: DataFrame, lists: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, mask) of the universe. It is written in about as many files as the pages are read in."""
    keys = slim.mapInArrow(shared.lean(lambda it: _candidate_rows(lengths, it)), "key string").distinct()
    out = keys.join(lists, "key", "left").select("key", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    return scratch.written(out.coalesce(max(1, slim.rdd.getNumPartitions())), "op9-universe")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages.

    rules: (key, verdict), key being host + beginning of path; listed: (key) that block where no rule fits.
    """
    spark = pages.sparkSession
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    # Bits of mask: 0 allows, 1 blocks, 2 listed.
    every = rules.select("key", F.when(F.col("verdict") == "block", 2).otherwise(1).alias("mask")).unionByName(listed.select("key", F.lit(4).alias("mask")))
    every = every.filter("key is not null and key != '' and key not like '/%'").groupBy("key").agg(F.bit_or("mask").alias("mask"))
    lists = shared.written(every.coalesce(max(1, rules.rdd.getNumPartitions() + listed.rdd.getNumPartitions())), "op9-lists", at := shared.table_path(spark, "op9-lists"))
    n = F.when(F.instr("key", "/") > 0, F.char_length("key") - F.instr("key", "/") + 1).otherwise(0)
    # Lengths of the path part of keys: a path is short, so these are few.
    by = lists.agg(F.collect_set(F.when(F.col("mask") % 4 > 0, n)).alias("rules"), F.collect_set(F.when(F.col("mask") >= 4, n)).alias("listed")).first()
    lengths, own = (tuple(sorted(by[k], reverse=True)) for k in ("rules", "listed"))
    with shared.Scratch(spark) as scratch:
        cascades = build_cascades(_marked(scratch, slim, lists, tuple(sorted({*lengths, *own}, reverse=True))), 3, max_bytes)
    if cascades is not None:
        shared.emptied(spark, at)
        sent = spark.sparkContext.broadcast(tuple(cascades))
        return slim.mapInArrow(shared.lean(lambda it: _judge(sent, lengths, own, default, it)), "page_id long, host string, path string, rule string, verdict string")
    marks = lists.select("key", F.when(F.col("mask").bitwiseAND(2) > 0, "block").when(F.col("mask").bitwiseAND(1) > 0, "allow").alias("verdict"), (F.col("mask") >= 4).alias("in_list"))
    return _judge_by_join(slim, marks.filter("verdict is not null"), marks.filter("in_list").select("key"), lengths, own, default)


def _explode(lengths: tuple[int, ...], own: tuple[int, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        urls, hosts, paths, keys, kinds = [], [], [], [], []
        for u in dict.fromkeys(b["url"].to_pylist()):
            host, path = split_url(u)
            for kind, k in [("", ""), *(("rule", k) for k in candidates(host, path, lengths)), *(("listed", k) for k in candidates(host, path, own))]:
                urls.append(u), hosts.append(host), paths.append(path), keys.append(k), kinds.append(kind)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (urls, hosts, paths, kinds, keys)], ["url", "host", "path", "kind", "key"])


def _judge_by_join(slim: DataFrame, rules: DataFrame, listed: DataFrame, lengths, own, default: str) -> DataFrame:
    """The same verdicts by joins, for lists whose filters are too large to broadcast."""
    keys = slim.select("url").distinct().mapInArrow(shared.lean(lambda it: _explode(lengths, own, it)), "url string, host string, path string, kind string, key string").distinct()
    every = rules.select("key", "verdict", F.lit("rule").alias("kind")).unionByName(listed.select("key", F.lit("block").alias("verdict"), F.lit("listed").alias("kind")))
    hit = keys.join(every, ["kind", "key"], "left")
    # In the order of candidates(): the longest key, the smallest of equally long ones.
    longest = F.when((F.col("kind") == "rule") & F.col("verdict").isNotNull(), F.struct((-F.char_length("key")).alias("n"), F.col("key"), F.col("verdict")))
    found = hit.groupBy("url", "host", "path").agg(F.min(longest).alias("best"), F.max(F.when(F.col("kind") == "listed", F.col("verdict"))).alias("other"))
    found = found.select(F.col("url").alias("of"), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", "other", F.lit(default)).alias("verdict"))
    return slim.join(found, slim["url"].eqNullSafe(found["of"])).select("page_id", "host", "path", "rule", "verdict")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "key string, verdict string").coalesce(1)


def default_listed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string").coalesce(1)
