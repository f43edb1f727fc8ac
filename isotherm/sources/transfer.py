"""Fetching files that are missing: probe, search in several roots, estimate, copy, with a result for each request."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .grids import list_files

_CHUNK = 1 << 20


@dataclass(frozen=True)
class Request:
    """target: the whole path the file shall have; roots: where to look, in this order; the first match by name is taken.

    pattern is a glob of the file's name; contains is a part of its path, whatever the case.
    """

    label: str
    target: str
    roots: tuple[str, ...]
    pattern: str
    contains: str = ""


def _listed(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """(root, path, length) of all files under each root; a root that isn't there has none."""
    from pyspark.errors import AnalysisException

    out = spark.createDataFrame([], "root string, path string, length long")
    for root in roots:
        try:
            out = out.unionByName(list_files(spark, root, exclude="").select(F.lit(root).alias("root"), "path", "length"))
        except AnalysisException:
            continue
    return out


def _plain(path):
    """A path without its scheme, as listings and callers may differ in it."""
    return F.regexp_replace(path, "^file:/*", "/")


def find(spark: SparkSession, requests: Sequence[Request]) -> DataFrame:
    """(label, target, present, source, length): what is there already, and the file found for what isn't.

    Each root is listed once. The requests are a short list, held against the listing.
    """
    rows = [(r.label, r.target, k, root, fnmatch.translate(r.pattern), r.contains.lower()) for r in requests for k, root in enumerate(r.roots)]
    wants = spark.createDataFrame(rows, "label string, target string, k int, root string, pattern string, contains string")
    folders = sorted({r.target.rpartition("/")[0] for r in requests})
    there = _listed(spark, folders).select(_plain(F.col("path")).alias("at")).distinct()
    files = _listed(spark, sorted({x for r in requests for x in r.roots}))
    fits = F.regexp(F.element_at(F.split("path", "/"), -1), F.col("pattern")) & F.contains(F.lower("path"), F.col("contains"))
    found = files.join(F.broadcast(wants), "root").filter(fits)
    first = F.row_number().over(Window.partitionBy("label", "target").orderBy("k", "path"))
    best = found.withColumn("n", first).filter("n = 1").select("label", "target", F.col("path").alias("source"), "length")
    asked = wants.select("label", "target").distinct()
    known = asked.join(there.withColumn("present", F.lit(True)), _plain(F.col("target")) == F.col("at"), "left").drop("at")
    return known.join(best, ["label", "target"], "left").select("label", "target", F.coalesce("present", F.lit(False)).alias("present"), "source", "length")


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies in pieces to a name of its own, then renames: a task that runs again does no harm."""
    from pyarrow import fs

    for b in batches:
        states = []
        for present, source, target in zip(b["present"].to_pylist(), b["source"].to_pylist(), b["target"].to_pylist()):
            if present or source is None:
                states.append("skipped" if present else "missing")
                continue
            try:
                (a, from_), (z, to) = fs.FileSystem.from_uri(source), fs.FileSystem.from_uri(target if ":" in target else f"file://{target}")
                z.create_dir(to.rpartition("/")[0], recursive=True)
                with a.open_input_stream(from_) as data, z.open_output_stream(f"{to}.part") as out:
                    while piece := data.read(_CHUNK):
                        out.write(piece)
                z.move(f"{to}.part", to)
                states.append("copied")
            except (OSError, pa.ArrowInvalid):
                states.append("failed")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string())], [*b.schema.names, "status"])


def fetch_missing(spark: SparkSession, requests: Sequence[Request], mb_per_second: float = 25.0) -> DataFrame:
    """(label, target, source, length, size_text, eta, status) of each request, a task for each file that is copied.

    status: skipped (it was there), copied, missing (no root has it) or failed (it could not be read or written).
    The copying is done when the result is asked for; asked for again, it finds the files there.
    """
    rows = find(spark, requests)
    dealt = rows.repartition(max(1, len(requests)), "label", "target")
    done = dealt.mapInArrow(_copy, "label string, target string, present boolean, source string, length long, status string")
    size = F.col("length")
    return done.select("label", "target", "source", "length", E.format_bytes(size).alias("size_text"), E.transfer_estimate(size, F.lit(float(mb_per_second))).alias("eta"), "status")
