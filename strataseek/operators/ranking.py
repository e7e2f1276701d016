"""BM25 full-text ranking over any table of documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import fold, fold_text

K1, B = 1.2, 0.75
#: A term in more than half of the documents still counts this much.
IDF_FLOOR = 1e-6
MAX_TERMS = 12
#: Words that never become query terms; a parameter of ``query_phrases``.
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on or that the this to was what which with".split())

_TERM = re.compile(r"[\w.\-]+")
_PART = re.compile(r"[^\W_]+")


class QueryError(ValueError):
    """A query from which nothing searchable is left."""

    code = "invalid_query"


def query_phrases(query: str, stop_words: frozenset[str] = STOP_WORDS) -> list[list[str]]:
    """Phrases of a query, in order, repeats kept: each word of ``[\\w.-]`` of two or more characters.

    Stop words and words beyond the first MAX_TERMS are dropped; a word is cut
    where the index cuts, so ``foo.bar`` is a phrase of two terms.
    """
    words = [w for w in _TERM.findall(query.strip()) if len(w) > 1 and w.lower() not in stop_words][:MAX_TERMS]
    phrases = [p for w in words if (p := _PART.findall(fold_text(w)))]
    if not phrases:
        raise QueryError("no searchable term is left in the query")
    return phrases


_L, _NOT, _END = r"(?<![\p{L}\p{N}])", r"[^\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"


def phrase_count(folded: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in a folded text; places may overlap."""
    words = [re.escape(w) for w in phrase]
    if len(words) == 1:
        return F.regexp_count(folded, F.lit(_L + words[0] + _END))
    return F.regexp_count(folded, F.lit(_L + words[0] + "(?=" + _NOT + _NOT.join(words[1:]) + _END + ")"))


def bm25(docs: DataFrame, text: str, phrases: list[list[str]]) -> DataFrame:
    """Documents that hold a phrase, with ``score`` = -BM25 (smaller is better).

    Statistics (number of documents, mean length, documents per phrase) cover
    all rows of ``docs``: filter the result, not the input. Two passes over the
    text and a single row in between; no text is shuffled. Null texts are
    documents without terms. A phrase that is repeated in the query counts
    again. Columns ``__*`` are dropped, all others kept.
    """
    folded = docs.withColumn("__t", fold(F.coalesce(F.col(text), F.lit(""))))
    counted = folded.withColumn("__dl", F.regexp_count("__t", F.lit(r"[\p{L}\p{N}]+")).cast("double")).withColumns({f"__f{i}": phrase_count(F.col("__t"), p).cast("double") for i, p in enumerate(phrases)}).drop("__t")
    k = range(len(phrases))
    stats = counted.agg(F.count("*").cast("double").alias("__n"), F.avg("__dl").alias("__avg"), *(F.sum((F.col(f"__f{i}") > 0).cast("double")).alias(f"__d{i}") for i in k))
    hits = counted.where(reduce(lambda a, b: a | b, (F.col(f"__f{i}") > 0 for i in k)))
    j = hits.crossJoin(F.broadcast(stats))  # one row of statistics
    norm = K1 * (1 - B + B * F.col("__dl") / F.col("__avg"))
    idf = lambda i: F.greatest(F.lit(IDF_FLOOR), F.log((F.col("__n") - F.col(f"__d{i}") + 0.5) / (F.col(f"__d{i}") + 0.5)))
    score = reduce(lambda a, b: a + b, (idf(i) * F.col(f"__f{i}") * (K1 + 1) / (F.col(f"__f{i}") + norm) for i in k))
    return j.withColumn("score", -score).drop("__n", "__avg", "__dl", *(f"__{x}{i}" for x in "fd" for i in k))


def after_key(df: DataFrame, keys: list[str], values: tuple) -> DataFrame:
    """Rows behind a key in ascending order (keyset page); keys must not be null."""
    return df.where(F.struct(*keys) > F.struct(*(F.lit(v).cast(dict(df.dtypes)[k]) for k, v in zip(keys, values, strict=True))))


def page(df: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The first ``limit`` rows by ``keys``, behind ``after`` if given."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return (after_key(df, keys, after) if after else df).orderBy(*keys).limit(limit)


def first_match(text: Column, phrases: list[list[str]]) -> Column:
    """1-based place of the first phrase in a text, by its folded form (1 if it only matches across marks)."""
    rx = "|".join(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(map(re.escape, p)) + r"(?![\p{L}\p{N}])" for p in phrases)
    return F.greatest(F.lit(1), F.regexp_instr(fold(text), F.lit(rx)))
