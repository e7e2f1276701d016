"""Oversized texts cut into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import line_count
from strataseek.operators.dedup import distinct_by_key

_LINE_END = re.compile(r"\r\n|\r|\n")
#: Separators from the strongest to the weakest; a cut lies at the end of a match. Characters come last.
_LEVELS = [
    re.compile(r"(?:(?<=\n)|(?<=\r))(?=#{1,6} |={2,6} ?\S|\\(?:sub)*section\b|\\chapter\b|<h[1-6]\b|(?:export |public |async |static )*(?:def|class|func|function|interface|package|module|struct|impl|CREATE|create)\b)|\f"),
    re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+"),
    re.compile(r"[.!?;][\"')\]»”]*[^\S\r\n]+|[。！？；]|\r\n|\r|\n"),
    re.compile(r"\s+"),
]
PIECES = "char_start long, char_end long, line_from long, line_to long"


def split_text(text: str, max_chars: int, max_lines: int, overlap_chars: int, overlap_lines: int) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (start, end, first line, last line), offsets in code points, lines from 0.

    The text is split into sections; a section too large for a piece is split
    into paragraphs, these into sentences or lines, words, characters. Parts
    are packed in order until the next one would break a limit. Each further
    piece begins with the tail of the one before: ``overlap_lines`` lines if
    the line limit ended it, else ``overlap_chars`` characters; so parts are
    kept small enough to leave room for that tail. Joined without their
    overlaps the pieces are the text. A text within the limits is one piece,
    an empty text none. A CRLF is not cut unless a piece has room for one
    character only.
    """
    if not (0 <= overlap_chars < max_chars and 0 <= overlap_lines < max_lines):
        raise ValueError("an overlap must be smaller than its limit")
    n = len(text)
    if not n:
        return []
    starts = [0, *(m.end() for m in _LINE_END.finditer(text) if m.end() < n)]
    line = lambda i: bisect_right(starts, i) - 1
    span = lambda a, b: line(b - 1) - line(a) + 1
    room, rows = max_chars - overlap_chars, max(1, max_lines - overlap_lines - 1)
    fits = lambda a, b: b - a <= room and span(a, b) <= rows
    if n <= max_chars and len(starts) <= max_lines:
        return [(0, n, 0, len(starts) - 1)]

    parts: list[tuple[int, int]] = []
    stack = [(0, n, 0)]
    while stack:
        a, b, level = stack.pop()
        if fits(a, b):
            parts.append((a, b))
        elif level < len(_LEVELS):
            cuts = [a, *(m.end() for m in _LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
            stack += [(x, y, level + 1) for x, y in reversed(list(zip(cuts, cuts[1:], strict=False)))]
        else:
            while a < b:
                e = min(a + room, b)
                if e < b and text[e - 1 : e + 1] == "\r\n" and e - 1 > a:
                    e -= 1
                parts.append((a, e))
                a = e

    out = []
    start = 0
    end = 0
    for a, b in parts:
        if end and (b - start > max_chars or span(start, b) > max_lines):
            out.append((start, end))
            if b - start <= max_chars:
                start = starts[max(0, line(end - 1) - overlap_lines + 1)] if overlap_lines else end
            else:
                start = end - overlap_chars
            # a tail of many lines, or of a long line, gives way to the limits
            while start < end and (b - start > max_chars or span(start, b) > max_lines):
                nxt = line(start) + 1
                start = min(end, max(b - max_chars, starts[nxt] if span(start, b) > max_lines and nxt < len(starts) else 0, start + 1))
        end = b
    out.append((start, end))
    return [(a, b, line(a), line(b - 1)) for a, b in out]


def limits_of(size_limits: DataFrame) -> dict[str, int]:
    """The arguments of ``split_text`` from the fixed table of limits: its units char and line, the smallest of each.

    A unit without a row has no limit.
    """
    rows = size_limits.where("unit IN ('char', 'line')").groupBy("unit").agg(F.min(F.struct("capacity", "overlap")).alias("x")).select("unit", "x.*").collect()
    free = {f"{kind}_{unit}s": value for unit in ("char", "line") for kind, value in (("max", 2**31 - 1), ("overlap", 0))}
    return free | {f"{kind}_{r.unit}s": int(r[col] or 0) for r in rows for kind, col in (("max", "capacity"), ("overlap", "overlap"))}


def split_oversized(chunks: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Pieces of all chunks: chunk_id, piece_no (from 1), n_pieces, char_start, char_end, line_start, line_end, content.

    ``chunks``: id, content, line_start. Sizes are tested in the JVM; only
    texts beyond a limit go to Python, the others pass as one piece. Repeated
    rows give their pieces once (only rows whose id is repeated are compared,
    different ones give the pieces of each); a null or empty content gives none; a null
    line_start counts as 1; other columns are ignored.
    """
    c = distinct_by_key(chunks.select(F.col("id").alias("chunk_id"), "content", F.coalesce("line_start", F.lit(1)).alias("first")), "chunk_id")
    c = c.where("content IS NOT NULL AND content <> ''").withColumn("n_lines", line_count(F.col("content")))
    over = (F.length("content") > limits["max_chars"]) | (F.col("n_lines") > limits["max_lines"])
    whole = c.where(~over).select("chunk_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("char_start"), F.length("content").cast("long").alias("char_end"), F.col("first").cast("long").alias("line_start"), (F.col("first") + F.col("n_lines") - 1).cast("long").alias("line_end"), "content")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, first, text in zip(pdf["chunk_id"], pdf["first"], pdf["content"], strict=True):
                pieces = split_text(text, **limits)
                yield pd.DataFrame(
                    [(key, i, len(pieces), a, b, first + p, first + q, text[a:b]) for i, (a, b, p, q) in enumerate(pieces, 1)],
                    columns=["chunk_id", "piece_no", "n_pieces", "char_start", "char_end", "line_start", "line_end", "content"],
                )

    cuts = c.where(over).select("chunk_id", "first", "content").mapInPandas(cut, f"chunk_id {dict(c.dtypes)['chunk_id']}, piece_no int, n_pieces int, char_start long, char_end long, line_start long, line_end long, content string")
    return whole.unionByName(cuts)
