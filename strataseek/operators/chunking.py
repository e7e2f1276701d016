"""Texts cut into chunks: without loss, or by lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MAX_LINES = 10_000, 180
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def lossless_chunks(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> list[tuple[str, int, int, int]]:
    """Chunks whose concatenation is the text: content, first line, last line (from 1, inclusive), start offset.

    A chunk ends at the line limit or the character limit, even within a line;
    CRLF is one line end and is cut only if the limit falls between its
    characters.
    """
    out, line, at = [], 1, 0
    start, first, n = 0, 1, 0
    for m in _LINE.finditer(text):
        a, b = m.span()
        if n == max_lines:
            out.append((text[start:a], first, line - 1, start))
            start, first, n = a, line, 0
        while b - start > max_chars:
            cut = start + max_chars
            out.append((text[start:cut], first, line, start))
            start, first, n = cut, line, 0
        n += 1
        line += 1
        at = b
    if at > start:
        out.append((text[start:at], first, line - 1, start))
    return out


def line_chunks(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> list[tuple[str, int, int]]:
    """Whole lines packed to the limits, trimmed, blank chunks dropped: content, first and last line. A longer line stays whole."""
    out, block, size, first = [], [], 0, 1
    lines = text.splitlines()
    for i, line in enumerate([*lines, None], 1):
        if block and (line is None or size + len(line) + 1 > max_chars or len(block) >= max_lines):
            body = "\n".join(block).strip()
            if body:
                out.append((body, first, i - 1))
            block, size, first = [], 0, i
        if line is not None:
            block.append(line)
            size += len(line) + 1
    return out


def chunk_table(docs: DataFrame, key: str, text: str, lossless: bool = True, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> DataFrame:
    """key, ordinal (from 0), content, line_start, line_end of every chunk; null and empty texts have none.

    Texts within both limits stay in the JVM when nothing is lost.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c[0], c[1], c[2]) for k, t in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate((lossless_chunks if lossless else line_chunks)(t, max_chars, max_lines))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "content", "line_start", "line_end"])

    from strataseek.functions.text import line_count

    rows = docs.select(key, text).where(F.col(text).isNotNull() & (F.col(text) != ""))
    schema = f"{key} {dict(docs.dtypes)[key]}, ordinal long, content string, line_start long, line_end long"
    if not lossless:
        return rows.mapInPandas(cut, schema)
    counted = rows.withColumn("__n", line_count(F.col(text)))
    small = (F.length(text) <= max_chars) & (F.col("__n") <= max_lines)
    whole = counted.where(small).select(key, F.lit(0).cast("long").alias("ordinal"), F.col(text).alias("content"), F.lit(1).cast("long").alias("line_start"), F.col("__n").cast("long").alias("line_end"))
    return whole.unionByName(counted.where(~small).select(key, text).mapInPandas(cut, schema))
