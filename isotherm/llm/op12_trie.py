"""Prefix trie of conversations, built level by level.

A node of depth d is a distinct sequence of first d turns; the conversations that begin with it are its
members, and the smallest of their ids names it (no two nodes of a depth share a member). Level d groups the
live conversations by (parent node, d-th turn): the group is the node, its smallest conv_id the name. A
conversation that is alone in its node is done: what follows is a chain of nodes of its own, written out in one step.
So there are as many levels as the longest sequence that two conversations share, and one more. Then the
levels are joined in reverse, children grouped by parent, and leaves and savings roll up to the root.

A turn is named by the SHA-256 of its role's length, role and text, so texts aren't shuffled. Turns are numbered
by a range partitioning of (conv_id, turn) and offsets for those conversations that cross its borders, so that a
conversation of any length is sorted by many tasks. Joins on a group that many rows share (``shared.joined``) send
groups of more than a ten-thousandth of all rows, at most 10,000 of them, to all tasks; the rest are shuffled.
Each level is a written table, which also ends its lineage.

The digest of a node's ends is of one list in order, so its bytes pass one task; that task gets them as
texts of up to BLOCK_CHARS characters, made beforehand by many, and holds one at a time.

Defined cases: rows without a conv_id belong to no conversation and are left out; turns are ordered by turn (null
first), equal ones by the turn's digest, so repeated rows count as turns of their own; a null role or text is
empty; an empty table gives no rows; other columns are left out. ``conv_id % 20`` of a negative id has its sign, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK_CHARS = 1 << 16
#: Nodes of a chain that one row stands for until it is expanded.
CHAIN = 4096
_NOTHING = hashlib.sha256(b"").hexdigest()


# --- turns in order


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with their place in the part of their conversation that this task has."""
    first, last, n = None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b["conv_id"].to_numpy()
        first = int(ids[0]) if first is None else first
        new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
        at = np.arange(len(ids))
        start = np.maximum.accumulate(np.where(new, at, 0 if new[0] else -n))
        place = at - start + 1
        last, n = int(ids[-1]), int(place[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array(ids == first)], [*b.schema.names, "place", "opens"])


def turns(conversations: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """(conv_id, depth, turn_key, n_words): each conversation's turns, numbered from 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("turn_key"), F.regexp_count(text("text"), F.lit(WORD)).cast("long").alias("n_words"))
    # Rows that are equal in all of these may come in any order: the last key only parts them.
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_key"), F.col("n")]
    rows = rows.filter("conv_id is not null").withColumn("n", F.monotonically_increasing_id())
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_key", "n_words")
    numbered = spread.mapInArrow(shared.lean(_number), "conv_id long, turn_key binary, n_words long, place long, opens boolean")
    table = scratch.written(numbered.withColumn("part", F.spark_partition_id()), "op12-numbered")
    edges = table.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("place", F.struct("conv_id", "place")).alias("n"))
    asked = edges.select(F.col("first").alias("conv_id"), "part", F.lit(0).cast("long").alias("n"), F.lit(0).alias("side"))
    given = edges.select(F.col("last").alias("conv_id"), "part", "n", F.lit(1).alias("side"))
    before = Window.partitionBy("conv_id").orderBy("part", "side").rowsBetween(Window.unboundedPreceding, -1)  # two rows for each task
    offset = asked.unionByName(given).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("side = 0").select("part", "offset")
    return table.join(F.broadcast(offset), "part").select("conv_id", (F.col("place") + F.when(F.col("opens"), F.col("offset")).otherwise(0)).alias("depth"), "turn_key", "n_words")


def lengths(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.count("*").alias("total"))


def rebuilt(rows: DataFrame, most: int, share: Column, base: Column, scratch: shared.Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first `share` turns are replaced by as many of conversation `base`: (turns, lengths).

    share (at most `most`) and base are expressions of conv_id. What the base lacks is missing in the result too, and a
    conversation without any turn left is there with length 0.
    """
    size = scratch.written(lengths(rows).withColumns({"share": share.cast("long"), "base": base.cast("long")}), "op12-sizes")
    based = size.select("base").distinct()
    first = rows.filter(F.col("depth") <= most).withColumnRenamed("conv_id", "base").join(based, "base", "left_semi")
    heads = first.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("depth", "turn_key", "n_words"))).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("share")), F.array().cast("array<struct<depth:bigint,turn_key:binary,n_words:bigint>>"))
    with_head = size.join(heads, "base", "left").select("conv_id", "share", F.col("total").alias("n_own"), head.alias("head"))
    whole = scratch.written(with_head.withColumn("total", F.size("head") + F.greatest(F.lit(0), F.col("n_own") - F.col("share"))), "op12-heads")
    shift = whole.select("conv_id", "share", "n_own", F.size("head").alias("n_head"))
    own = shared.joined(rows, shift, ["conv_id"], "n_own").filter(F.col("depth") > F.col("share"))
    own = own.select("conv_id", (F.col("depth") - F.col("share") + F.col("n_head")).alias("depth"), "turn_key", "n_words")
    return own.unionByName(whole.select("conv_id", F.inline("head"))), whole.select("conv_id", "total")


# --- digests of ends


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ends of a node as texts of about BLOCK_CHARS characters."""
    out: list[tuple] = []
    node, first, ids, size = None, 0, [], 0
    for b in batches:
        for depth, name, c in zip(b["depth"].to_pylist(), b["node"].to_pylist(), b["conv_id"].to_pylist()):
            if ids and (node != (depth, name) or size >= BLOCK_CHARS):
                out.append((*node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = (depth, name), c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if sum(len(x[3]) for x in out) > shared.PIECE_BYTES:
            yield _frame(out)
            out = []
    if ids:
        out.append((*node, first, ",".join(ids)))
    yield _frame(out)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["depth", "node", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node, from its blocks in order."""
    node, state = None, None
    for b in batches:
        done: list[tuple] = []
        for depth, name, ids in zip(b["depth"].to_pylist(), b["node"].to_pylist(), b["ids"]):
            if (depth, name) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, name), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        yield _digests(done)
    yield _digests([(*node, state.hexdigest())] if node else [])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["depth", "node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id), conv_ids ascending and joined by commas."""
    order = ["depth", "node", "conv_id"]
    blocks = ends.select(*(F.col(c).cast("long").alias(c) for c in order)).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = blocks.mapInArrow(shared.lean(_blocks), "depth long, node long, first long, ids string")
    return blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(shared.lean(_digest), "depth long, node long, ends_sha256 string")


# --- the trie


def trie(rows: DataFrame, totals: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """Nodes of the trie of (conv_id, depth, turn_key, n_words), with each conversation's number of turns (conv_id, total).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; both tables are read more
    than once. The scratch tables may go when the result has been made: it reads none of them.
    """
    spark = rows.sparkSession
    root = totals.agg(F.min("conv_id").alias("node"), F.count("*").alias("n")).filter("n > 0")
    live = scratch.written(totals.crossJoin(F.broadcast(root.select("node"))), "op12-live").select("conv_id", "node", "total")
    ends = [live.filter("total = 0").select(F.lit(0).alias("depth"), "node", "conv_id")]
    levels: list[DataFrame] = []
    live, depth = live.filter("total > 0"), 0
    while not live.isEmpty():
        depth += 1
        if depth > 2 and depth & (depth - 1) == 0:  # most turns are of no use any more
            rows = scratch.written(rows.filter(F.col("depth") >= depth).join(live.select("conv_id"), "conv_id", "left_semi"), "op12-turns")
        own = rows.filter(F.col("depth") == depth).drop("depth")
        step = scratch.written(live.withColumnRenamed("node", "parent").join(own, "conv_id"), "op12-step")
        group = step.groupBy("parent", "turn_key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.max("total").alias("total"))
        levels.append(level := scratch.written(group, "op12-level"))
        several = level.filter("n > 1").select("parent", "turn_key", "node", "n")
        live = scratch.written(shared.joined(step.drop("n_words"), several, ["parent", "turn_key"], "n").select("conv_id", "node", "total"), "op12-live")
        ends.append(live.filter(F.col("total") == depth).select(F.lit(depth).alias("depth"), "node", "conv_id"))
        live = live.filter(F.col("total") > depth)

    path, below = shared.table_path(spark, "op12-nodes"), None
    kind = "node long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, total long"
    none = spark.createDataFrame([], kind)
    for d in range(len(levels), -1, -1):
        up = (below if below is not None else none).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        here = levels[d - 1] if d else root.select(F.lit(None).cast("long").alias("parent"), "node", "n", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("total"))
        shared_ = here.filter("n > 1" if d else "true").join(up, "node", "left")
        shared_ = shared_.select(
            "node", "parent", F.col("n").alias("n_convs"), F.coalesce("c", F.lit(0)).alias("n_children"), F.coalesce("l", F.lit(1)).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("n_words") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), F.lit(None).cast("long").alias("total"),
        )
        if d:
            alone = here.filter("n = 1").select("node", "parent", F.col("n").alias("n_convs"), (F.col("total") > d).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "total")
            shared_ = shared_.unionByName(alone)
        below = shared.written(shared_, "op12-nodes", f"{path}/depth={d}")

    nodes = spark.read.schema(f"{kind}, depth int").parquet(path).withColumn("depth", F.col("depth").cast("long"))
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)
    digests = shared.written(ends_digests(every), "op12-ends")
    named = nodes.join(digests, ["depth", "node"], "left")
    last = F.when(F.col("total") == F.col("depth"), F.sha2(F.col("node").cast("string"), 256))
    top = named.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", last, F.lit(_NOTHING)).alias("ends_sha256"))
    return top.unionByName(_chains(nodes.filter(F.col("total") > F.col("depth"))))


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes below those of a single conversation, which has more turns. A long chain is dealt out in pieces."""
    pieces = alone.select("node", "total", F.explode(F.sequence(F.col("depth") + 1, F.col("total"), F.lit(CHAIN).cast("long"))).alias("from"))
    dealt = pieces.repartition(F.col("node"), F.col("from"))
    at = dealt.select("node", "total", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHAIN - 1, F.col("total")))).alias("depth"))
    last = F.col("depth") == F.col("total")
    one, nought = F.lit(1).cast("long"), F.lit(0).cast("long")
    return at.select(
        F.col("node").alias("conv_id"), "depth", F.col("node").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, nought).otherwise(one).alias("n_children"), one.alias("n_leaves"), nought.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("node").cast("string"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations (conv_id, turn, role, text) as they are."""
    with shared.Scratch(conversations.sparkSession) as scratch:
        rows = scratch.written(turns(conversations, scratch), "op12-turns")
        return trie(rows, scratch.written(lengths(rows), "op12-lengths"), scratch)


#: What the query rebuilds conversations by: the base's id, and how many of its turns at most.
BASE_STEP, MOST_SHARED = 20, 3


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of conversations c that begin with the first crc32(c) % 4 turns of conversation c - c % 20."""
    c = F.col("conv_id")
    share = F.crc32(c.cast("string")) % (MOST_SHARED + 1)
    with shared.Scratch(conversations.sparkSession) as scratch:
        rows = scratch.written(turns(conversations, scratch), "op12-turns")
        own, totals = rebuilt(rows, MOST_SHARED, share, c - c % BASE_STEP, scratch)
        return trie(scratch.written(own, "op12-rebuilt"), scratch.written(totals, "op12-lengths"), scratch)
