"""Packing by concatenation: documents follow each other as one stream of token ids, cut every `window` tokens.

First pass: each task tokenises its documents and writes their ids with the number of tokens before them in
that task. The table is written, so a row's task and place in it are settled, whichever attempt of a task
was the one that counted. A sum for each task, and prefix sums over those sums, give each task its place in
the stream. Second pass: a document begins at its task's place plus its own; it is cut where the stream
passes a multiple of the window. Each piece is a boundary record: which document, from which of its tokens,
how many, in which sequence and where. Nothing but the sums of tasks is exchanged.

Which documents meet in a sequence depends on how the table is split for the tasks; that every sequence but
the last is full doesn't. Only the last can need padding, fewer tokens than a window in all. A sequence whose
length is a power of two is left as it is.

Ids: every maximal run of letters, every number, every run of other characters is a pre-token, as the tokenizer
has them, and stands for itself, so a worker remembers the ids of pre-tokens, and those of whole stretches between
white space (each in two generations of at most MEMO). This holds for characters below U+0250, where splitting
and lower-casing are the same everywhere; what stands between white space and holds another character is given to the tokenizer as a whole.

Scale: the ids take 2 bytes a token on disk (4 for vocabularies of more than 65,536). The sums are a row for each
task; they are broadcast while there are at most MAX_PARTS of them (16 MB), beyond it they are joined.

Defined cases: a null text is empty, so its document is one end token; a null doc_id stays null; repeated rows are
packed each by itself; an empty table gives no rows; other columns are left out. Control strings of the
tokenizer inside a text are ordinary text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WINDOW = 4096
END = 2
MEMO = 250_000
MAX_PARTS = 1_000_000
MAX_TOKENIZER_BYTES = 64 << 20

#: Characters whose splitting and lower-casing don't depend on a Unicode version or on what stands around them.
_PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
_SPACES = re.compile("[ \t\n\v\f\r]+")
#: Fixed value: pre-tokens of the tokenizer.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, int]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: b if b in printable else next(others) for b in range(256)}


_BYTE_LETTERS = _byte_letters()


class Encoder(dict):
    """Plain lower-case pre-token -> its ids as packed little-endian integers; bounded by two generations."""

    def __init__(self, definition: str, most: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model, self.width = self.tokenizer.model, _width(self.tokenizer.get_vocab_size())
        self.letter = "H" if self.width == 2 else "I"
        self.most, self.old = most, {}
        self.chunks = Chunks(self)

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.packed([x.id for x in self.model.tokenize(letters)])
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text: those of its stretches between white space, one after the other."""
        if not text:
            return b""
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        return b"".join([self.chunks[c.lower() if _PLAIN.fullmatch(c) else c] for c in _SPACES.split(text) if c])


class Chunks(dict):
    """Stretch without white space (lower-cased if plain) -> packed ids, bounded like the encoder's memo."""

    def __init__(self, own: Encoder):
        self.own, self.old = own, {}

    def __missing__(self, chunk: str) -> bytes:
        own, ids = self.own, self.old.get(chunk)
        if ids is None:
            if _PLAIN.fullmatch(chunk):
                ids = b"".join(map(own.__getitem__, _PRETOKEN.findall(chunk)))
            else:
                ids = own.packed(own.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= 64:
            if len(self) >= own.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def _width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


_encoders: list[tuple[str, Encoder]] = []


def encoder(definition: str) -> Encoder:
    """This worker's encoder; that of another tokenizer replaces it."""
    if not _encoders or _encoders[0][0] != definition:
        _encoders[:] = [(definition, Encoder(definition))]
    return _encoders[0][1]


def load(path: str) -> str:
    """The definition of a tokenizer (JSON), read by the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(text) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} characters")
    return text


_TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def _tokens(broadcast, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, part, before = encoder(broadcast.value), TaskContext.get().partitionId(), 0
    last = own.packed([end])
    for b in batches:
        ids = [own.encode(t) + last for t in b["text"].to_pylist()]
        sizes = np.array([len(x) // own.width for x in ids], np.int64)
        starts = before + np.cumsum(sizes) - sizes
        before += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.full(len(ids), part)), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())], schema=_TOKENS)


def tokens(docs: DataFrame, definition: str, end: int = END) -> DataFrame:
    """doc_id, part (task), before (tokens before it in that task), doc_tokens and ids of each document, written."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(definition)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = slim.mapInArrow(shared.lean(lambda it: _tokens(sent, end, it)), "doc_id long, part long, before long, doc_tokens long, ids binary")
    return shared.written(made, "op11-tokens")


def places(table: DataFrame) -> DataFrame:
    """(part, base): where each task's tokens begin in the stream, by prefix sums over the totals of tasks."""
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


_PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(window: int, width: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_PIECES, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    for b in batches:
        rows: list[tuple] = []
        for doc_id, at, raw in zip(b["doc_id"].to_pylist(), b["at"].to_pylist(), b["ids"]):
            ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
            start = 0
            while start < len(ids):
                sequence, offset = divmod(at + start, window)
                own = ids[start : start + window - offset]
                rows.append((doc_id, start, len(own), zlib.crc32(own.tobytes()), len(ids), sequence, offset, *([own.astype(np.int32)] if with_ids else [])))
                start += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def pack(docs: DataFrame, definition: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids: its ids too."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = _width(Tokenizer.from_str(definition).get_vocab_size())
    table = tokens(docs, definition, end)
    base = shared.written(places(table), "op11-places")
    n = base.count()
    placed = table.join(F.broadcast(base) if n <= MAX_PARTS else base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    return placed.mapInArrow(shared.lean(lambda it: _cut(window, width, with_ids, it)), _PIECES_DDL + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, ids (padded, unless their number is a power of two), n_tokens and boundaries, from pieces with ids.

    boundaries: doc_id, start, offset and length of each piece in order. A sequence has at most `window` pieces.
    """
    one = F.struct("offset", "doc_id", "start", "length", "ids")
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("p"), F.sum("length").alias("n_tokens"))
    ids, n = F.flatten(F.transform("p", lambda x: x["ids"])), F.col("n_tokens").cast("int")
    power = n.bitwiseAND(n - 1) == 0
    padded = F.when(power, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad), F.lit(window) - n)))
    boundaries = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return got.select("sequence_id", padded.alias("ids"), "n_tokens", boundaries.alias("boundaries"))
