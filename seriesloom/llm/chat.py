"""Conversations to training text, and back.

A template (template.py) writes the turns; its control strings are escaped
inside roles and texts by a backslash after their first character, and a
backslash by another, so that no control string is left in a text and the
turns and the text under the loss mask can be read back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.template import compile_template

#: What the template below marks turns with. None begins inside another or with a backslash.
OPEN, HEAD, CLOSE, MARK = "<turn>", "\n", "</turn>", "### "
TEMPLATE = (
    "{% for m in messages %}"
    "<turn>### {{ m.role | head }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
_TEXT = re.compile(r"\\|<turn>|</turn>|### ")
_ROLE = re.compile(r"\\|<turn>|</turn>|### |\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_CONTROL = re.compile(r"\\.|<turn>### |</turn>\n|\n", re.DOTALL)


def _broken(m: re.Match) -> str:
    return m[0][:1] + "\\" + m[0][1:] if len(m[0]) > 1 else "\\" + m[0]


def escape(s: str) -> str:
    """A backslash before every backslash, and one inside every control string."""
    return _TEXT.sub(_broken, s)


def escape_role(s: str) -> str:
    """As escape, and with a backslash before a line feed, which ends a role."""
    return _ROLE.sub(_broken, s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


@lru_cache(maxsize=16)
def renderer(template: str):
    return compile_template(template, {"escape": escape, "head": escape_role})


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TEMPLATE wrote."""
    turns, role, at, state = [], "", 0, "between"
    for m in _CONTROL.finditer(formatted):
        mark = m[0]
        if state == "between" and mark == OPEN + MARK and m.start() == at:
            at, state = m.end(), "role"
        elif state == "role" and mark == HEAD:
            role, at, state = unescape(formatted[at : m.start()]), m.end(), "text"
        elif state == "text" and mark == CLOSE + "\n":
            turns.append((role, unescape(formatted[at : m.start()])))
            at, state = m.end(), "between"
        elif mark[0] == "\\" or (state == "text" and mark == HEAD):
            continue
        else:
            raise ValueError(f"unexpected {mark!r} at {m.start()}")
    if state != "between" or at != len(formatted):
        raise ValueError("the text ends inside a turn")
    return turns


FORMATTED = "conv_id long, n_turns long, formatted string, mask array<struct<start: long, end: long>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, formatted, mask (code point spans under the loss): one row per conversation.

    Turns come in order of `turn`, nulls first, ties by role and text. Null
    roles and texts count as empty. Rows with a null conv_id are one
    conversation with a null id. An empty table gives an empty result. A
    conversation is formatted as a whole, by one task.
    """
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [render({"messages": turns}) for turns in part.column(1).to_pylist()]
                n = [len(x) for x in part.column(1).to_pylist()]
                mask = [[{"start": a, "end": b} for a, b in spans] for _, spans in found]
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array([f for f, _ in found], pa.string()), pa.array(mask, kinds)], ["conv_id", "n_turns", "formatted", "mask"])

    return whole.mapInArrow(run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, _, shown, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(shown)
                whole = sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(shown[m["start"] : m["end"]]) for m in mask)
                out.append((conv_id, len(turns), whole, len(loss), sha256(loss.encode()).hexdigest(), len(shown)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
