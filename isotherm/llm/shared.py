"""What several operators of this subpackage need: word splitting, digests, places for tables."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import inspect
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece of an Arrow batch, about. Spark bounds a batch by bytes itself (64 MB, or one row); Python objects take several times that.
PIECE_BYTES = 4 << 20

#: Separators of lower-cased alphanumeric words: all ASCII but 0-9 and A-Z, a-z.
_ALNUM = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Lower-cases A-Z and leaves the rest.
ASCII_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def utf8(text: str | None) -> bytes:
    """A text's bytes; null is empty; a lone surrogate, which no valid column holds, becomes '?'."""
    return text.encode("utf-8", "replace") if text else b""


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, as UTF-8."""
    return utf8(text).translate(_ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, as UTF-8. bytes.split() knows exactly these six separators."""
    return utf8(text).split()


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets a local one.

    On a cluster without the setting it is refused: each executor would write to a disk of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "isotherm-shared")
    return at.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def transient_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are run to their end in here leave no shuffle files behind; the setting is then as it was."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. It survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = path or table_path(spark, name)
    with transient_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def emptied(spark: SparkSession, *paths: str) -> None:
    """Free the space of tables that nothing reads any more: each is overwritten with no rows."""
    for path in paths:
        spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


class Scratch:
    """Tables that one call needs and its result doesn't: their space is freed at the end of the with block.

    They lie in one folder, so that one overwriting frees them all.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.n = spark, [table_path(spark, "scratch")], 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return written(df, name, f"{self.paths[0]}/{name}-{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.n:
            emptied(self.spark, *self.paths)


#: Groups with more rows than 1 / HOT_SHARE of all, and than HOT_LEAST, are joined by broadcast.
HOT_SHARE, HOT_LEAST = 10_000, 1_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], size: str, rows: int | None = None, least: int | None = None) -> DataFrame:
    """left inner join right on keys, which right has once; its column `size` tells how many rows of left have them.

    A group of many rows isn't gathered: such groups, HOT_SHARE of them at most, go to all tasks, and only rows of the
    others are shuffled. rows: how many left has, where that is known.
    """
    rows = left.count() if rows is None else rows
    limit = max(HOT_LEAST if least is None else least, rows // HOT_SHARE)
    if rows <= limit:
        return left.join(right, keys)
    hot = right.filter(F.col(size) > limit)
    if hot.isEmpty():
        return left.join(right, keys)
    names = F.broadcast(hot.select(*keys))
    cold = left.join(names, keys, "left_anti").join(right.filter(F.col(size) <= limit), keys)
    return cold.unionByName(left.join(F.broadcast(hot), keys))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column: one cheap aggregate, used to size partitions."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def parts(amount: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(amount / each))


# --- memory of Python workers, which outlive tasks


def _libc():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: nothing to trim
        return None


def trim() -> None:
    """Give freed memory back to the system."""
    if "trim" not in _loaded:
        _loaded["trim"] = _libc()
    if _loaded["trim"]:
        _loaded["trim"](0)


_loaded: dict[str, object] = {}


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE_BYTES, or one row where rows are longer."""
    for b in batches:
        each = max(1, b.num_rows * PIECE_BYTES // max(1, b.nbytes))
        for at in range(0, max(1, b.num_rows), each):
            yield b.slice(at, each)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gets small pieces, and leaves nothing behind in its worker when it is through."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(pieces(batches))
        finally:
            gc.collect()
            trim()

    return run


def lean_group(f: Callable) -> Callable:
    """The same for a function of one group or two."""

    def one(a):
        try:
            return f(a)
        finally:
            trim()

    def two(a, b):
        try:
            return f(a, b)
        finally:
            trim()

    return one if len(inspect.signature(f).parameters) == 1 else two
