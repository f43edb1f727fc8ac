"""WARC: not-modified revisits get the response they stand for, and a reader and writer of WARC records.

``resolve`` is an as-of join: for each revisit (the answer was 304 Not Modified) the latest earlier full
response of the same canonical URL. The validators that both of them name (ETag, Last-Modified) must agree;
then the headers of the response are merged with those that a 304 may update.

Scale: the as-of join carries record numbers only, not headers or payloads. Rows are sorted by (URL, time) over
partitions of equal numbers of rows, so a hot URL, even one with all its records in one second, is spread over as
many partitions as it fills. Each partition is read once in order; what its first URL had before it comes from a
table of one row a partition. Then revisits meet the headers of their response, which tell the outcome, and only those
that are resolved its payload. A response of many revisits is there once for every ``SPREAD`` of them, so these joins are
spread too; revisits without a response take no part in them.

Defined cases: a null or empty URL matches nothing; a null time is before all times, and not earlier than
another null; a response at the time of the revisit isn't earlier; among responses of equal time the one with
the largest record_id is the latest; ids name records: of several rows of one type and id the one with the smallest
time, then URL, then content counts, and a null id names none; a revisit without an earlier response has outcome
no_response; null headers are no headers; header names compare without case, ETags without the mark of weak ones.
The reader gives a row with status cut_off for a record that its file ends in, and one with status unreadable where
a file's compression is broken; other records of the file are there.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Headers of a 304 that replace those of the stored response (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified")
VALIDATORS = ("etag", "last-modified")
#: Rows of a partition of the sorted records, about.
SLICE_ROWS = 100_000
#: So many revisits share a copy of their response in the last joins.
SPREAD = 2_000
#: Bytes of bodies in a batch of the reader, about, unless one record is larger.
BATCH_BYTES = 8 << 20
#: Query parameters that name no other page.
TRACKING = "^(utm_[a-z]+|gclid|fbclid)(=|$)"


def canonical_url(url):
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters, others sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, rest = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail)
    return F.when((scheme == "") | (host == ""), F.lit(None)).otherwise(whole)


def header(headers, name: str):
    """A header's value, whatever the case of its name; the first in order of name, if there are several."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(F.array_sort(hits), F.lit(1))["value"]


def _lowered(headers):
    """Entries with lower-case names, one for each name."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.transform(names, lambda n: F.struct(n.alias("key"), F.array_min(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"])).alias("value")))


def merged_headers(stored, update):
    """Headers of the stored response, with those of the 304 that may replace or join them; sorted by name."""
    allowed = F.filter(_lowered(update), lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(allowed, lambda e: e["key"])
    kept = F.filter(_lowered(stored), lambda e: ~F.array_contains(names, e["key"]))
    return F.array_sort(F.concat(kept, allowed))


def _latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted: each revisit with the last response before it, then a row about the partition.

    open: the revisit is of the partition's first URL, and no response of that came yet. The last row has the first
    and the last URL, and the last response of the last URL.
    """
    number, first, url, carried, kind = TaskContext.get().partitionId(), None, None, None, None

    def rows(n, record, response, open_, first, last):
        return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), record, response, open_, pa.array([first] * n, pa.string()), pa.array([last] * n, pa.string())], ["slice", "record_id", "response_id", "open", "first", "last"])

    for b in batches:
        if not (n := b.num_rows):
            continue
        urls, ids, revisit = b["url"], b["record_id"], b["is_revisit"].to_numpy(zero_copy_only=False)
        kind, first = ids.type, urls[0].as_py() if first is None else first
        new = np.concatenate(([urls[0].as_py() != url], pc.not_equal(urls[1:], urls[:-1]).to_numpy(zero_copy_only=False).astype(bool)))
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(new, at, -1))  # -1: the URL of the batch before goes on
        last = np.maximum.accumulate(np.where(revisit, -1, at))
        # Place 0 is what is carried over from the batch before, place k + 1 is row k.
        place = np.where(last >= np.maximum(begin, 0), last + 1, np.where(begin < 0, 0, -1))
        pool = pa.concat_arrays([pa.array([carried], kind), ids])
        near = pool.take(pa.array(place, mask=place < 0))
        of_first = pc.equal(urls, first)
        url, carried = urls[n - 1].as_py(), near[n - 1].as_py()
        keep = pa.array(revisit)
        near, ids, of_first = near.filter(keep), ids.filter(keep), of_first.filter(keep)
        yield rows(len(ids), ids, near, pc.and_(of_first, pc.is_null(near)), None, None)
    if kind is not None:
        yield rows(1, pa.nulls(1, kind), pa.array([carried], kind), pa.array([None], pa.bool_()), first, url)


def latest_earlier(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(record_id, response_id) of each revisit; records: record_id, url, time, is_revisit, one row a record."""
    slim = records.select("record_id", "url", F.coalesce(F.col("time").cast("long"), F.lit(-(1 << 62))).alias("time"), "is_revisit")
    with shared.Scratch(records.sparkSession) as scratch:
        scanned = _scanned(scratch.written(slim.filter("url is not null and record_id is not null"), "op8-records"), slice_rows)
    kind = dict(scanned.dtypes)["record_id"]
    parts = scanned.filter("first is not null")
    asks = parts.select(F.col("first").alias("url"), "slice", F.lit(0).alias("k"), F.lit(None).cast(kind).alias("response_id"))
    ends = parts.select(F.col("last").alias("url"), "slice", F.lit(1).alias("k"), "response_id")
    before = F.last("response_id", ignorenulls=True).over(Window.partitionBy("url").orderBy("slice", "k"))
    carried = asks.unionByName(ends).withColumn("far", before).filter("k = 0").select("slice", "far")
    found = scanned.filter("first is null").join(carried, "slice", "left")
    return found.select("record_id", F.coalesce("response_id", F.when(F.col("open"), F.col("far"))).alias("response_id"))


def _scanned(known: DataFrame, slice_rows: int) -> DataFrame:
    """What _latest says about each partition of the sorted records."""
    # Revisits come before responses of the same time: those aren't earlier.
    order = ["url", "time", F.col("is_revisit").desc(), "record_id"]
    kind = dict(known.dtypes)["record_id"]
    dealt = known.repartitionByRange(shared.parts(known.count(), slice_rows), *order).sortWithinPartitions(*order)
    scanned = dealt.mapInArrow(shared.lean(_latest), f"slice int, record_id {kind}, response_id {kind}, open boolean, first string, last string")
    return shared.written(scanned, "op8-scanned")  # partitions keep their numbers


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS, spread: int = SPREAD) -> DataFrame:
    """One row for each revisit of records (record_id, type, url, time, headers map, payload).

    record_id, url (canonical), response_id, outcome (resolved, validator_mismatch, no_response), headers
    (merged, sorted by name) and payload; the last two are null unless resolved. spread: revisits that share a copy of
    their response.
    """
    rows = records.select("record_id", "type", canonical_url(F.col("url")).alias("url"), "time", "headers", "payload").filter("record_id is not null")
    slim = rows.filter(F.col("type").isin("response", "revisit")).groupBy("record_id", "type").agg(F.min(F.struct("time", "url")).alias("m"))
    asof = latest_earlier(slim.select("record_id", "m.url", "m.time", (F.col("type") == "revisit").alias("is_revisit")), slice_rows)

    def once(kind: str, content) -> DataFrame:
        """One row of each record, where rows are for the join anyway."""
        of = rows.filter(F.col("type") == kind).withColumn("content", F.xxhash64(*content))
        first = F.row_number().over(Window.partitionBy("record_id").orderBy("time", "url", "content"))
        return of.withColumn("n", first).filter("n = 1")

    entries = F.array_sort(F.map_entries("headers"))
    asof = shared.written(asof, "op8-asof")
    asked = asof.filter("response_id is not null")
    counts = asked.groupBy("response_id").agg(F.count("*").alias("n"))
    copies = F.floor(F.col("n") / spread)  # of a response besides the first, so that as many tasks share its revisits
    dealt = shared.joined(asked, counts, ["response_id"], "n").withColumn("copy", F.pmod(F.xxhash64("record_id"), copies + 1))

    def copied(responses: DataFrame) -> DataFrame:
        """Each response that is asked for, once for each copy. The join needs no other exchange than once()."""
        return responses.withColumnRenamed("record_id", "response_id").join(counts, "response_id").withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("n")

    revisits = once("revisit", [entries]).select("record_id", "url", "headers")
    plain = once("response", [entries, "payload"])
    stored = copied(plain.select("record_id", F.col("headers").alias("stored")))
    agree = F.lit(True)
    for v in VALIDATORS:
        mine, other = (F.regexp_replace(header(F.col(c), v), "^W/", "") for c in ("headers", "stored"))
        agree = agree & F.coalesce(mine == other, F.lit(True))
    # Outcomes are told by headers alone; payloads come last, and only for what is resolved.
    found = revisits.join(dealt.select("record_id", "response_id", "copy"), "record_id").join(stored, ["response_id", "copy"])
    told = shared.written(found.select("record_id", "url", "response_id", "copy", agree.alias("good"), F.when(agree, merged_headers(F.col("stored"), F.col("headers"))).alias("headers")), "op8-told")
    bodies = copied(plain.select("record_id", "payload"))
    columns = ["record_id", "url", "response_id", "outcome", "headers", "payload"]
    none = F.lit(None).cast(dict(records.dtypes)["payload"]).alias("payload")
    resolved = told.filter("good").join(bodies, ["response_id", "copy"]).withColumn("outcome", F.lit("resolved"))
    others = told.filter("not good").select("*", F.lit("validator_mismatch").alias("outcome"), none)
    lone = revisits.drop("headers").join(asked.select("record_id"), "record_id", "left_anti")
    kinds = dict(told.dtypes)
    lone = lone.select("record_id", "url", F.lit(None).cast(kinds["response_id"]).alias("response_id"), F.lit("no_response").alias("outcome"), F.lit(None).cast(kinds["headers"]).alias("headers"), none)
    return resolved.select(*columns).unionByName(others.select(*columns)).unionByName(lone)


# --- the format --------------------------------------------------------------------------------


def encode(record: dict) -> bytes:
    """One WARC/1.1 record: type, url, date, id, fields (more WARC fields), body."""
    body = record.get("body") or b""
    lines = ["WARC/1.1", f"WARC-Type: {record['type']}", f"WARC-Record-ID: {record['id']}", f"WARC-Date: {record['date']}"]
    lines += [f"WARC-Target-URI: {record['url']}"] * bool(record.get("url"))
    lines += [f"{k}: {v}" for k, v in sorted((record.get("fields") or {}).items())] + [f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


_HEAD = re.compile(rb"WARC/1\.[01]\r?\n")


class Gunzipped(io.RawIOBase):
    """The bytes of a gzip file of any number of members; where its compression breaks they end, and broken is set."""

    def __init__(self, file):
        self.file, self.member, self.inside, self.left, self.broken = file, zlib.decompressobj(31), False, b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.broken:
            self.left = self.left or self.file.read(1 << 16)
            if not self.left:
                self.broken = self.inside
                break
            try:
                data = self.member.decompress(self.left, len(out))
            except zlib.error:
                self.broken = True
                break
            self.inside = not self.member.eof
            self.left = self.member.unconsumed_tail if self.inside else self.member.unused_data
            if not self.inside:
                self.member = zlib.decompressobj(31)
            if data:
                out[: len(data)] = data
                return len(data)
        return 0


def decode(data: bytes | io.BufferedReader, strict: bool = True) -> Iterator[dict]:
    """The records of an uncompressed WARC file, read as they are asked for, each with its status.

    strict: a record that is cut off, or compression that is broken, raises ValueError instead of giving a status.
    """
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    fields: dict[str, str] | None = None
    body = b""
    while line := file.readline():
        if not _HEAD.fullmatch(line):
            continue
        fields, body = {}, b""
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "0")
        size = int(size) if size.isdecimal() else 0
        body = file.read(size) if line else b""
        if not line or len(body) < size:
            break
        yield _record(fields, body, "ok")
        fields = None
    broken = getattr(getattr(file, "raw", None), "broken", False)
    if strict and (broken or fields is not None):
        raise ValueError("the file is broken" if broken else "a record is cut off")
    if broken or fields is not None:
        yield _record(fields or {}, body, "unreadable" if broken else "cut_off")


def _record(fields: dict[str, str], body: bytes, status: str) -> dict:
    return {"type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "status": status, "fields": fields, "body": body}


def http_parts(body: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an HTTP message."""
    head, _, payload = body.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, payload


def _decode_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the files named, streamed; files are opened by address, so nothing is read as a whole."""
    from pyarrow import fs

    def batch(path, rows):
        names = ("type", "id", "url", "date", "status")
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], pa.string()) for k in names), pa.array([list(r["fields"].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r["body"] for r in rows], pa.binary())],
            ["path", *names, "fields", "body"],
        )

    for b in batches:
        for path in b["path"].to_pylist():
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, held = [], 0
                for r in decode(io.BufferedReader(Gunzipped(raw) if packed else raw), strict=False):
                    rows.append(r)
                    held += len(r["body"])
                    if held >= BATCH_BYTES or len(rows) >= 1000:
                        yield batch(path, rows)
                        rows, held = [], 0
                yield batch(path, rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files (plain or gzip) under a path; a file is one task's, which streams it.

    Spark lists the files; tasks open them themselves, so the path must be of a store that pyarrow opens too.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(shared.lean(_decode_files), "path string, type string, id string, url string, date string, status string, fields map<string,string>, body binary")
