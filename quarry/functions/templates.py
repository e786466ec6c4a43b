"""Text formats compiled into concat expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import fixed_values as fv

_SLOT = re.compile(r"\{(idx|source|content|chunks|bullet|kv|escaped|messy|question|file|error)\}")


def fill(template: str, **slots: Column) -> Column:
    """``template`` with every ``{slot}`` replaced by a column."""
    pieces = _SLOT.split(template)
    parts = [F.lit(p) if i % 2 == 0 else slots[p] for i, p in enumerate(pieces) if i % 2 or p]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def pick(index: Column, choices: list[Column]) -> Column:
    """The choice at a zero-based index; only that one is evaluated."""
    out = F.when(index == 0, choices[0])
    for i, choice in enumerate(choices[1:], 1):
        out = out.when(index == i, choice)
    return out


def rotate(number: Column, length: int) -> Column:
    return F.pmod(number, F.lit(length)).cast("int")


def render_chunk(kind: Column, idx: Column, source: Column, content: Column) -> Column:
    return pick(
        kind,
        [fill(t, idx=idx.cast("string"), source=source, content=content) for t in fv.CHUNK_FORMATS],
    )


def escape_quotes(text: Column, limit: int | None = fv.ESCAPED_CONTEXT_CHARS) -> Column:
    escaped = F.replace(text, F.lit('"'), F.lit('\\"'))
    return escaped if limit is None else F.substring(escaped, 1, limit)


def render_example(
    kind: Column,
    question: Column,
    chunks: Column,
    plain: Column,
    kv: Column,
    bullet: Column | None = None,
    escape_limit: int | None = fv.ESCAPED_CONTEXT_CHARS,
) -> Column:
    """One training prompt in the format with index ``kind``."""
    slots = {
        "chunks": chunks,
        "bullet": plain if bullet is None else bullet,
        "kv": kv,
        "escaped": escape_quotes(plain, escape_limit),
        "messy": plain,
        "question": question,
    }
    return pick(kind, [fill(t, **slots) for t in fv.PROMPT_FORMATS])


def error_message(template_by_type: Column, file: Column, error: Column) -> Column:
    return F.replace(F.replace(template_by_type, F.lit("{file}"), file), F.lit("{error}"), error)
