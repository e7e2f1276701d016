"""Text scalars as Spark column expressions, with Python twins where a UDF needs them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def slugify(c: Column) -> Column:
    """Slug of a name or path; null stays null.

    The last path segment, every run outside ``[A-Za-z0-9._-]`` as one ``-``,
    no ``.``, ``-`` or ``_`` at the ends, lower case, ``item`` when nothing is left.
    """
    last = F.element_at(F.split(F.translate(strip(c), "\\", "/"), "/"), -1)
    runs = F.regexp_replace(last, r"[^A-Za-z0-9._-]+", "-")
    bare = F.lower(F.regexp_replace(runs, r"^[.\-_]+|[.\-_]+$", ""))
    return F.when(c.isNull(), None).otherwise(F.when(bare == "", "item").otherwise(bare))


def slug_text(value: str) -> str:
    """``slugify`` for a Python string."""
    last = re.split(r"[\\/]", value.strip())[-1]
    return re.sub(r"[^A-Za-z0-9._-]+", "-", last).strip(".-_").lower() or "item"


def path_key(c: Column) -> Column:
    """Comparable form of a relative path: ``/`` as separator, no leading ``./``, lower case."""
    return F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", ""))


def compact_line(c: Column, limit: int) -> Column:
    """One line: white space collapsed, cut to ``limit - 1`` characters plus an ellipsis."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def line_count(c: Column) -> Column:
    """Lines ending at LF, CRLF or a lone CR; an end at the very end opens no further line."""
    ends = F.length(F.regexp_replace(c, r"\r\n", "\n"))
    breaks = ends - F.length(F.translate(F.regexp_replace(c, r"\r\n", "\n"), "\r\n", ""))
    return F.when(F.length(c) == 0, 0).otherwise(breaks + F.when(c.rlike(r"[\r\n]\z"), 0).otherwise(1))


def instant(c: Column) -> Column:
    """ISO 8601 text in any usual spelling as a timestamp; UTC where no offset is given; null if unreadable."""
    s = strip(c)
    return F.try_to_timestamp(F.when(s.rlike(r"(?i)(z|[+-]\d{2}:?\d{0,2})$") & s.rlike(r"[T ]\d"), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(s, F.lit("Z"))))


def json_strings(c: Column) -> Column:
    """String items of a JSON list in text; an empty array for other JSON, invalid text and null."""
    items = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    texts = F.filter(items, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def _accent_map() -> tuple[str, str]:
    """Precomposed Latin letters and their bases, from the Unicode decompositions to one base letter."""
    import unicodedata

    pairs = []
    for start, end in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(start, end):
            d = unicodedata.normalize("NFD", chr(cp))
            if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(c) for c in d[1:]):
                pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS, _BASES = _accent_map()


def fold(c: Column) -> Column:
    """Lower case without Latin diacritics, inside code generation."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, _ACCENTS, _BASES)).otherwise(low)


def fold_text(s: str) -> str:
    """``fold`` for a Python string."""
    return s.lower().translate(str.maketrans(_ACCENTS, _BASES))


def terms(c: Column) -> Column:
    """Terms of the full-text index: folded runs of letters and numbers; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), 0), F.array().cast("array<string>"))


def snippet(c: Column, start: Column, before: int = 48, width: int = 256) -> Column:
    """``width`` characters beginning ``before`` characters ahead of the 1-based ``start``."""
    return F.substr(c, F.greatest(start - before, F.lit(1)), F.lit(width))


def bracketed(c: Column, words: list[str], before: int = 8, width: int = 24) -> Column:
    """``width`` terms of a text around the first of ``words`` (folded), each of them in brackets; null where none stands in it.

    Terms are joined by single blanks; what is left out at an end shows as ``...``.
    """
    raw = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), 0)
    hit = lambda t: fold(t).isin(words)
    first = F.array_position(F.transform(raw, hit), True)
    start = F.greatest(first - before, F.lit(1)).cast("int")
    part = F.transform(F.slice(raw, start, F.lit(width)), lambda t: F.when(hit(t), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
    text = F.concat(F.when(start > 1, "... ").otherwise(""), F.array_join(part, " "), F.when(start + width - 1 < F.size(raw), " ...").otherwise(""))
    return F.when(first > 0, text)


def markdown_table(names: list[str], rows: list[tuple]) -> str:
    """Rows as a Markdown table; bars and line ends in cells are escaped."""
    cell = lambda v: re.sub(r"\s+", " ", "" if v is None else str(v)).replace("|", "\\|").strip()
    line = lambda vs: "| " + " | ".join(map(cell, vs)) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)])


def window(c: Column, offset: Column | int, length: Column | int) -> Column:
    """Characters [offset, offset + length) with offset from 0."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(c, as_col(offset) + 1, as_col(length))


#: Sentence enders of Latin and CJK text, line ends, and a dot that does not stand between digits.
CLAIM_END = r"[!?;。！？；\r\n]+|(?<![0-9])\.|\.(?![0-9])"


def claims(c: Column) -> Column:
    """Claims of a text: trimmed, not empty, in order."""
    return F.filter(F.transform(F.split(c, CLAIM_END), strip), lambda x: x != "")
