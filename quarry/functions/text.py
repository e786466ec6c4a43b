"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import fixed_values as fv

# ---------------------------------------------------------------- fixed values
# Every character the stripping rule treats as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
    "    　"
)
BLOCK_STEPS = 80


def strip(text: Column) -> Column:
    """Remove blanks, Unicode ones included, from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def first_line(text: Column, limit: int = fv.FIRST_LINE_CHARS) -> Column:
    return F.substring(F.substring_index(strip(text), "\n", 1), 1, limit)


def decode_utf8(content: Column) -> Column:
    """Bytes to text, bad sequences replaced instead of failing the row."""
    return F.make_valid_utf8(content.cast("string"))


def fingerprint(content: Column) -> Column:
    """Content identity of text or bytes."""
    return F.sha2(content, 256)


def chunk_array(text: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Overlapping character windows, stripped, blank ones dropped before numbering.

    Long texts are sliced in two levels (blocks, then windows), so that the
    character search of ``substring`` never starts over from the beginning of a
    very long text for every single window.
    """
    step = size - overlap
    stride = step * BLOCK_STEPS
    last = F.greatest(F.length(text) - F.lit(overlap + 1), F.lit(0))

    def windows(block: Column) -> Column:
        end = F.least(F.lit(stride - step), last - block["start"])
        return F.transform(
            F.sequence(F.lit(0), end, F.lit(step)),
            lambda p: strip(F.substring(block["body"], p + 1, F.lit(size))),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), last, F.lit(stride)),
        lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(stride + size)).alias("body")),
    )
    return F.filter(F.flatten(F.transform(blocks, windows)), lambda c: c != "")


def read_preview(text: Column, extension: Column, limit: int = fv.PREVIEW_CHARS) -> Column:
    """struct(text, truncated, file_type); null for unsupported file types."""
    kind = F.when(extension.isin(fv.PREVIEW_EXTENSIONS), "text").when(extension == ".pdf", "pdf")
    return F.when(
        kind.isNotNull(),
        F.struct(
            F.substring(text, 1, limit).alias("text"),
            (F.length(text) > limit).alias("truncated"),
            kind.alias("file_type"),
        ),
    )


def chat_title(prompt: Column, limit: int = fv.TITLE_CHARS) -> Column:
    return F.when(F.length(prompt) > limit, F.concat(F.substring(prompt, 1, limit), F.lit("..."))).otherwise(prompt)


def memory_tags(text: Column) -> Column:
    """Facts between memory tags, trimmed, empty ones dropped."""
    found = F.regexp_extract_all(text, F.lit("(?s)<memory>(.*?)</memory>"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda m: m != "")


def strip_memory_tags(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?s)<memory>.*?</memory>", ""))


def is_refusal(output: Column) -> Column:
    return F.contains(F.lower(output), F.lit(fv.REFUSAL_MARK))


def answer_prompt(context: Column, question: Column) -> Column:
    has_context = F.coalesce(strip(context) != "", F.lit(False))
    return F.when(
        has_context, F.concat(F.lit("Context: "), context, F.lit("\n\nQuestion: "), question)
    ).otherwise(question)
