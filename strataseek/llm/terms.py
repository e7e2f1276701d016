"""How distinctive a term is of a record: graph-of-words degree times collection rarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.operators.skew import join_facts
from strataseek.runtime import materialise

_TERM = regex.compile(r"[\p{L}\p{N}]+")
#: Texts are scored together up to this many characters, which bounds the memory of a worker.
_SLICE = 1_000_000
_OUT = pa.schema([("source_table", pa.string()), ("record_id", pa.int64()), ("term", pa.string()), ("tf", pa.int32()), ("degree", pa.int32())])


def graph_of_words(texts: list[str], window: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of several texts with their frequency and number of distinct neighbours in each.

    Two terms of a text are neighbours if fewer than ``window`` positions
    apart; a term is no neighbour of itself. Result: vocabulary, and for each
    pair of text and term the indices of both, frequency and degree.
    """
    code: dict[str, int] = {}
    lists = [[code.setdefault(t, len(code)) for t in _TERM.findall(x.lower())] for x in texts]
    rec = np.repeat(np.arange(len(lists), dtype=np.int64), [len(x) for x in lists])
    ids = np.fromiter((i for x in lists for i in x), dtype=np.int64, count=len(rec))
    v = max(1, len(code))
    nodes, tf = np.unique(rec * v + ids, return_counts=True)
    at = np.searchsorted(nodes, rec * v + ids)
    edges = []
    for gap in range(1, window):
        a, b = at[:-gap], at[gap:]
        ok = (rec[:-gap] == rec[gap:]) & (a != b)
        a, b = a[ok], b[ok]
        edges.append(np.minimum(a, b) * len(nodes) + np.maximum(a, b))
    pairs = np.unique(np.concatenate(edges)) if edges else np.empty(0, np.int64)
    degree = np.bincount(pairs // max(1, len(nodes)), minlength=len(nodes)) + np.bincount(pairs % max(1, len(nodes)), minlength=len(nodes))
    return list(code), nodes // v, nodes % v, tf, degree


def term_graphs(records: DataFrame, window: int = 4) -> DataFrame:
    """source_table, record_id, term, tf, degree of every term of every record.

    ``records``: source_table, record_id, content, one row per record. Terms
    are maximal runs of Unicode letters and numbers of the lower-cased
    content. Null or empty contents have none.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("content").to_pylist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= _SLICE):
                    size += len(texts[b])
                    b += 1
                words, rec, term, tf, degree = graph_of_words(texts[a:b], window)
                part = batch.slice(a, b - a)
                take = pa.array(rec)
                yield pa.RecordBatch.from_arrays(
                    [part.column("source_table").take(take), part.column("record_id").take(take), pa.array(words, pa.string()).take(pa.array(term)), pa.array(tf, pa.int32()), pa.array(degree, pa.int32())], schema=_OUT
                )
                a = b

    rows = records.where("content IS NOT NULL").select("source_table", F.col("record_id").cast("long").alias("record_id"), "content")
    return rows.mapInArrow(score, "source_table string, record_id long, term string, tf int, degree int")


def score_terms(records: DataFrame, window: int = 4) -> DataFrame:
    """Score of every term of every record: adds df (records that hold the term) and weight.

    weight = degree * ln((N + 1) / df) with N records in the collection, so a
    word of every record weighs next to nothing and a rare word bound to many
    different words of its record weighs most. The graphs are built once and
    written; document frequencies and the join read them back. Common terms,
    of which there is a bounded number, meet their frequency by broadcast,
    rare ones by shuffle, so no task gets all rows of a common term. One row
    per record and term; no records give no rows.
    """
    graphs = materialise(term_graphs(records, window))
    facts = materialise(graphs.groupBy("term").agg(F.count("*").alias("df")))
    n = records.count()
    scored = join_facts(graphs, facts, ["term"], "df", graphs.count())
    weight = F.round(F.col("degree") * F.log((F.lit(float(n)) + 1) / F.col("df")), 9)
    return scored.select("source_table", "record_id", "term", "tf", "degree", "df", weight.alias("weight"))
