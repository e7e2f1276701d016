"""A stored inverted index: written once, extended part by part, read by the terms of a query."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import terms
from strataseek.operators.ranking import B, IDF_FLOOR, K1

#: Partitions of the index by a hash of the term; a query reads those of its terms only.
BUCKETS = 64
POSTINGS = "domain int, term string, doc string, tf int, positions array<int>, dl int, bucket int"
STATS = "domain int, n_docs long, n_terms long"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, key: str, text: str, domain: int = 0) -> DataFrame:
    """POSTINGS of documents: one row per term and document, with its positions (from 0) and the document's length.

    Terms are cut in the JVM and counted within the batch that holds the
    document, so no token is shuffled, only finished rows on their way to
    their partition. Null and empty texts have no rows; they count in ``corpus``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, doc, places, dl = [], [], [], []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
                term += at
                places += at.values()
                doc += [key] * len(at)
                dl += [len(words)] * len(at)
            columns = [pa.array(term, pa.string()), pa.array(doc, pa.string()), pa.array([len(x) for x in places], pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(dl, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "doc", "tf", "positions", "dl"])

    cut = docs.select(F.col(key).cast("string").alias("doc"), terms(F.col(text)).alias("words"))
    rows = cut.mapInArrow(count, "term string, doc string, tf int, positions array<int>, dl int")
    return rows.select(F.lit(domain).alias("domain"), "term", "doc", "tf", "positions", "dl", bucket(F.col("term")).alias("bucket"))


def corpus(docs: DataFrame, text: str, domain: int = 0) -> DataFrame:
    """STATS of documents: their number and their terms, empty ones included."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(terms(F.col(text))).cast("long")), F.lit(0).cast("long")).alias("n_terms")).select(F.lit(domain).alias("domain"), "n_docs", "n_terms")


def arranged(rows: DataFrame) -> DataFrame:
    """Postings as they are written: a bucket in one place, sorted by term, so that a term is few row groups."""
    return rows.repartition("bucket").sortWithinPartitions("bucket", "term")


def write(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write a whole index of one domain below ``path``."""
    arranged(postings(docs, key, text)).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    corpus(docs, text).write.parquet(f"{path}/stats")


def search(index: DataFrame, stats: DataFrame, phrases: list[list[str]], domain: int = 0) -> DataFrame:
    """doc, score (= -BM25) of the documents of a domain that hold a phrase.

    ``index``: POSTINGS, partitioned by ``bucket``; only the partitions of the
    query's terms are read, and only their rows are shuffled. ``stats``: STATS,
    one row per written part. Phrases of several terms are found by their
    positions; a phrase repeated in the query counts again.
    """
    wanted = sorted({t for p in phrases for t in p})
    spark = index.sparkSession
    buckets = sorted({r.b for r in spark.createDataFrame([(t,) for t in wanted], "t string").select(bucket(F.col("t")).alias("b")).collect()})
    size = stats.where(F.col("domain") == domain).agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    n, mean = float(size.n or 0), float(size.t or 0) / float(size.n or 1)
    rows = index.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted) & (F.col("domain") == domain))
    per_doc = rows.groupBy("doc").agg(F.max("dl").alias("dl"), *(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"__p{i}") for i, t in enumerate(wanted)))
    at = {t: F.coalesce(F.col(f"__p{i}"), F.array().cast("array<int>")) for i, t in enumerate(wanted)}

    def tf(p: list[str]) -> Column:
        starts = at[p[0]]
        for i in range(1, len(p)):
            starts = F.array_intersect(starts, F.transform(at[p[i]], lambda x: x - i))  # noqa: B023 - called at once
        return F.size(starts).cast("double")

    k = range(len(phrases))
    counted = per_doc.select("doc", "dl", *(tf(p).alias(f"__f{i}") for i, p in enumerate(phrases)))
    hits = counted.where(reduce(lambda a, b: a | b, (F.col(f"__f{i}") > 0 for i in k)))
    df = hits.agg(*(F.coalesce(F.sum((F.col(f"__f{i}") > 0).cast("double")), F.lit(0.0)).alias(f"__d{i}") for i in k)).first()
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(mean or 1.0))
    idf = lambda i: F.greatest(F.lit(IDF_FLOOR), F.log(F.lit((n - df[i] + 0.5) / (df[i] + 0.5))))
    return hits.select("doc", (-reduce(lambda a, b: a + b, (idf(i) * F.col(f"__f{i}") * (K1 + 1) / (F.col(f"__f{i}") + norm) for i in k))).alias("score"))
