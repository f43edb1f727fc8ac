"""Chat formatting: a state machine over roles and a declarative template.

The machine reads the turns of a conversation in order and marks it valid if each role may follow the one
before. The template gives each role its opening and closing control strings and says whether its text counts
in the loss. A turn becomes three segments, the middle one its text; only texts of loss roles are under the
loss mask. Control strings inside texts are broken up by a backslash after their first character, and
backslashes doubled, so the output can be parsed again and texts come back exactly.

Scale: one shuffle by conversation; rows are sorted by Spark (which spills) and stream through Python, which
holds one turn and the state of two running digests. A digest over a whole conversation is serial by nature,
so the turns of one conversation pass through one task, but they are never gathered in memory.

Defined cases: rows come by turn, null turns first, ties by role, then text (nulls first); null text is
empty; an unknown or null role is written with its name (null: empty) in a mark of its own, makes the
conversation invalid and isn't under the loss; rows with a null conv_id are one conversation; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Mark:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Mark]
    other: tuple[str, str, str]  # around the name, then after the text, of a role that isn't listed
    #: State -> roles that may come next. The state is the last role; "" is the start.
    order: dict[str, tuple[str, ...]]
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        found = {c for m in self.roles.values() for c in (m.opening, m.closing)} | set(self.other)
        if any(len(c) < 2 or self.escape in c for c in found) or len({m.opening for m in self.roles.values()}) < len(self.roles):
            raise ValueError("control strings need two characters, no escape character, and openings of their own")
        object.__setattr__(self, "controls", tuple(sorted(found, key=lambda c: (-len(c), c))))

    def quote(self, text: str) -> str:
        e = self.escape
        text = text.replace(e, e + e)
        for c in self.controls:
            text = text.replace(c, c[0] + e + c[1:])
        return text

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S) if self.escape in text else text

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """The segments of a turn, each with its loss flag."""
        body = self.quote(text or "")
        if m := self.roles.get(role):
            return [(m.opening, False), (body, m.loss), (m.closing, False)]
        before, after, end = self.other
        return [(before + self.quote(role or "") + after, False), (body, False), (end, False)]

    def parse(self, formatted: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, loss) of each turn of formatted output."""
        at = 0
        opening = {m.opening: (r, m) for r, m in self.roles.items()}
        before, after, end = self.other
        while at < len(formatted):
            start = next((c for c in self.controls if formatted.startswith(c, at) and (c in opening or c == before)), None)
            if start is None:
                raise ValueError(f"no turn begins at {at}")
            at += len(start)
            if start == before:
                stop = formatted.index(after, at)
                role, close, loss = self.unquote(formatted[at:stop]), end, False
                at = stop + len(after)
            else:
                role, m = opening[start]
                close, loss = m.closing, m.loss
            stop = formatted.index(close, at)
            yield role, self.unquote(formatted[at:stop]), loss
            at = stop + len(close)


TEMPLATE = Template(
    roles={"system": Mark("<<SYS>>", "<</SYS>>"), "user": Mark("[INST]", "[/INST]"), "assistant": Mark("<s>", "</s>", True), "tool": Mark("<tool>", "</tool>")},
    other=("<role>", "</role>", "</turn>"),
    order={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("tool", "assistant")},
)

_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
_TURNS = "conv_id long, turn_no long, valid boolean, segments array<struct<text: string, loss: boolean>>"


def _format(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; valid tells whether the order is legal up to the turn."""
    conv, state, valid, no = object(), "", True, 0
    for b in batches:
        out = []
        for c, role, text in zip(b["conv_id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist()):
            if c != conv:
                conv, state, valid, no = c, "", True, 0
            valid = valid and role in template.order.get(state, ())
            state = role
            out.append((c, no, valid, [{"text": t, "loss": x} for t, x in template.segments(role, text)]))
            no += 1
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), _SEGMENTS))], ["conv_id", "turn_no", "valid", "segments"])


def segments(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row for each turn, in order within each partition, with all of a conversation in one partition."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(shared.lean(lambda it: _format(template, it)), _TURNS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _read_back(template: Template, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)

    conv, state = object(), None
    for b in batches:
        done = []
        for c, valid, segs in zip(b["conv_id"].to_pylist(), b["valid"].to_pylist(), b["segments"].to_pylist()):
            if state is None or c != conv:
                if state:
                    done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
            formatted = "".join(s["text"] for s in segs)
            for role, text, _ in template.parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            for s in segs:
                if s["loss"]:
                    text = template.unquote(s["text"])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "replace"))
            state[4] += len(formatted)
            state[5] = valid
        yield batch(done)
    if state:
        yield batch([(conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])])


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What segments() wrote, parsed again and digested by conversation."""
    return formatted.mapInArrow(shared.lean(lambda it: _read_back(template, it)), _DIGEST)
