"""Fill-in-the-middle transformation: a text is cut into prefix, middle and suffix and told in another order.

Units are runs of A-Z and a-z, or single other characters; they tile the text. An Arrow-batched pandas UDF
walks them with finditer and keeps only where each ends, in a compact array; the two cuts are two lookups
in it, and slices of the text give the parts. Where to cut and which form to take comes from a digest of the
doc_id alone, so a run gives the same rows whatever the partitioning, and after executors are lost.

Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix, middle). Each part stands behind
its mark. A text that holds a mark itself stays plain, so the marks of an output are always its own and
``restore`` finds the text again: a mark begins with ``<`` and holds no other ``<``, so no mark can arise where a
part and a mark meet.

Scale: one scan, no shuffle, no state; a worker holds one Arrow batch and the array of one text (4 bytes a unit).

Defined cases: a null text is empty and stays plain; a null doc_id counts as the empty decimal; rows are
independent, so repeated rows give equal results; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of those that are told suffix first.
RATE, SPM_RATE = 90, 20

_PARTS = "n long, form string, prefix_chars long, middle_chars long"
#: Characters of text that are turned into results at a time.
_SLICE = 8 << 20


def unit_ends(text: str) -> array:
    """Where each unit of a text ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def seeds(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that a doc_id fixes."""
    head = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()[:16]
    return tuple(int.from_bytes(head[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(doc_id: int | None, text: str, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    h1, h2, h3, h4 = seeds(doc_id)
    ends = unit_ends(text)
    n = len(ends)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, _, rest = output.removeprefix(first).partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def _slices(*series: pd.Series, by: pd.Series) -> Iterator[list[pd.Series]]:
    """Consecutive rows with about _SLICE characters of `by` together."""
    at = (by.str.len().fillna(0).cumsum() // _SLICE).to_numpy()
    start = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[start]:
            yield [s.iloc[start:k] for s in series]
            start = k


def _ids(ids: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in ids.tolist()]


def _transform(rate: int, spm_rate: int, digest: bool):
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            if ids.empty:
                yield pd.DataFrame({c: [] for c in _columns(digest)})
            for some_ids, some in _slices(ids, texts, by=texts):
                rows = []
                for doc_id, text in zip(_ids(some_ids), some.tolist()):
                    *parts, output = transformed(doc_id, text or "", rate, spm_rate)
                    if digest:
                        rows.append((*parts, shared.sha(shared.utf8(output)), shared.sha(shared.utf8(restored(output, parts[1])))))
                    else:
                        rows.append((*parts, output))
                yield pd.DataFrame(rows, columns=_columns(digest)).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        shared.trim()

    return udf


def _columns(digest: bool) -> list[str]:
    return ["n", "form", "prefix_chars", "middle_chars", *(("output_sha256", "restored_sha256") if digest else ("output",))]


def _with(docs: DataFrame, rate: int, spm_rate: int, digest: bool) -> DataFrame:
    kind = f"{_PARTS}, {'output_sha256 string, restored_sha256 string' if digest else 'output string'}"
    typed = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    f = _transform(rate, spm_rate, digest)
    f.__annotations__ = typed
    made = F.pandas_udf(f, kind)(F.col("doc_id"), F.col("text"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output (the text in its new order)."""
    return _with(docs, rate, spm_rate, digest=False)


def digests(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The same with output_sha256 and restored_sha256, of the text that output and form give again, instead of output."""
    return _with(docs, rate, spm_rate, digest=True)


def restore(made: DataFrame) -> DataFrame:
    """doc_id and text of each row of ``transform``."""

    def udf(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs.tolist(), forms.tolist())], dtype=object)

    udf.__annotations__ = {"outputs": pd.Series, "forms": pd.Series, "return": pd.Series}
    return made.select("doc_id", F.pandas_udf(udf, "string")("output", "form").alias("text"))
