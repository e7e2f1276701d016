"""Full-text search queries over documents, chunks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import text as T
from strataseek.operators import fulltext as X
from strataseek.operators import ranking as R
from strataseek.operators.dedup import one_per_key
from strataseek.runtime import scratch_path, spread, table

QUERY = "evidence claim résumé"
PHRASE_QUERY = "stale.summary notebook"


_indexes: dict[tuple[str, str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics of a table's texts, written once per application to the shared folder and read from there."""
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _indexes:
        docs = table(spark, sf_dir, name).select(key, text)
        docs = one_per_key(spread(docs, key), key) if name != "documents" else spread(docs, key)
        path = scratch_path(spark)
        X.write(docs, key, text, path)
        _indexes[at] = path
    path = _indexes[at]
    return spark.read.schema(X.POSTINGS).parquet(f"{path}/postings"), spark.read.schema(X.STATS).parquet(f"{path}/stats")


def search_table(spark: SparkSession, sf_dir: str, name: str, key: str, text: str, query: str) -> DataFrame:
    """key and score (rounded to 6 digits) of the rows of a table that a query hits, by its stored index."""
    index, stats = stored_index(spark, sf_dir, name, key, text)
    return X.search(index, stats, R.query_phrases(query)).select(F.col("doc").cast("long").alias(key), F.round("score", 6).alias("score"))


def _with_source(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def _ranked(spark: SparkSession, sf_dir: str, query: str = QUERY) -> DataFrame:
    return search_table(spark, sf_dir, "documents", "doc_id", "text", query)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for a query, with the text around the first match."""
    hits = R.page(_ranked(spark, sf_dir), ["score", "doc_id"], 10)
    # the texts of one page, at most 100 ids, are all that is read of the documents
    texts = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(F.broadcast(hits), "doc_id")
    return texts.select("doc_id", "source", "score", T.snippet(F.col("text"), R.first_match(F.col("text"), R.query_phrases(QUERY))).alias("snippet"))


def bm25_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project filter comes after scoring and changes no score."""
    return R.page(_with_source(spark, sf_dir, _ranked(spark, sf_dir)).where("source = 'amber-parser'"), ["score", "doc_id"], 20).select("doc_id", "score")


def bm25_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind a score and id."""
    return R.page(_ranked(spark, sf_dir), ["score", "doc_id"], 20, after=(-2.0, 0)).select("doc_id", "score")


def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted word is a phrase of neighbouring terms; every hit."""
    return _ranked(spark, sf_dir, PHRASE_QUERY).select("doc_id", "score")


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit by the stored index: partitions and row groups of the query's terms only."""
    return search_table(spark, sf_dir, "documents", "doc_id", "text", PHRASE_QUERY)


def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores without an index: two passes over all texts, for collections searched once."""
    return R.bm25(_docs(spark, sf_dir), "text", R.query_phrases(PHRASE_QUERY)).select("doc_id", F.round("score", 6).alias("score"))


def summary_then_evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries always come before evidence, whatever their scores; each domain has its own statistics."""
    parts = [search_table(spark, sf_dir, name, "id", "content", "refresh job").select(F.lit(domain).alias("domain"), F.col("id").alias("source_id"), "score") for domain, name in enumerate(("summaries", "chunks"))]
    return R.page(parts[0].unionByName(parts[1]), ["domain", "score", "source_id"], 100)


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the index with document frequency and occurrences."""
    index, _ = stored_index(spark, sf_dir, "documents", "doc_id", "text")
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search for up to six terms, ignoring case, with a preview."""
    c = one_per_key(table(spark, sf_dir, "chunks").select("id", "content"), "id")
    low = F.lower("content")
    return c.where(low.contains("checksum") | low.contains("passphrase")).select("id", F.substring("content", 1, 700).alias("preview"))


def coverage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted coverage: share of the query's term weight that a document holds, less a prior for its length."""
    weights = {"evidence": 4, "claim": 4, "stale": 4, "zituprax": 12}
    toks = T.terms(F.col("text"))
    docs = _docs(spark, sf_dir).withColumn("t", toks)
    held = sum((F.when(F.array_contains("t", w), F.lit(x)).otherwise(F.lit(0)) for w, x in weights.items()), F.lit(0))
    scored = docs.select("doc_id", (held / F.lit(float(sum(weights.values())))).alias("coverage"), F.size("t").alias("n_terms")).where("coverage > 0")
    return scored.select("doc_id", F.round(F.col("coverage") * 1000 - F.least(F.lit(100.0), F.col("n_terms") / 100.0), 6).alias("score"))


def documents_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact retrieval: whitelisted fields of the best hits."""
    hits = R.page(_ranked(spark, sf_dir, "parser budget"), ["score", "doc_id"], 20)
    full = table(spark, sf_dir, "documents").select("doc_id", "source", "rel_path", "lang", "n_chars")
    return full.join(F.broadcast(hits), "doc_id")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_project_filter, bm25_keyset_page, bm25_phrase, bm25_index, bm25_scan, summary_then_evidence_search, index_terms, like_fallback, coverage_rank)} | {"compact_retrieve": documents_like}

_T = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def _score(source: str, key: str, text: str, phrases: list[str]) -> str:
    """Common table expressions that end in ``ranked`` (key, score)."""
    spaced = "(' ' || array_to_string(t, '  ') || ' ')"
    tf = ", ".join(f"((length({spaced}) - length(replace({spaced}, '{x}', ''))) / {len(x)})::DOUBLE AS f{i}" for i, p in enumerate(phrases) for x in [" " + "  ".join(p.split()) + " "])
    stats = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(phrases)))
    part = " + ".join(f"greatest(1e-6, ln((n - d{i} + 0.5) / (d{i} + 0.5))) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(phrases)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""toks AS (SELECT *, {_T.format(text)} AS t FROM {source}), counted AS (SELECT * EXCLUDE (t), len(t)::DOUBLE AS dl, {tf} FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS av, {stats} FROM counted), ranked AS (SELECT counted.*, round(-({part}), 6) AS score FROM counted, stats WHERE {some})"""


_Q = ["evidence", "claim", "resume"]
_TOP = f"WITH {_score('documents', 'doc_id', 'text', _Q)}\n"
_FIRST = f"""greatest(1, coalesce(length(strip_accents(lower(text))) - length(regexp_replace(strip_accents(lower(text)), '(?s)^(.*?)(^|[^\\p{{L}}\\p{{N}}])((evidence|claim|resume)([^\\p{{L}}\\p{{N}}].*)?$)', '\\3')), 0) + 1)"""
_PH = ["stale summary", "notebook"]

ORACLES = {
    "bm25_topk": _TOP + f"SELECT doc_id, source, score, substr(text, greatest({_FIRST} - 48, 1)::BIGINT, 256) AS snippet FROM ranked ORDER BY score, doc_id LIMIT 10",
    "bm25_project_filter": _TOP + "SELECT doc_id, score FROM ranked WHERE source = 'amber-parser' ORDER BY score, doc_id LIMIT 20",
    "bm25_keyset_page": _TOP + "SELECT doc_id, score FROM ranked WHERE (score, doc_id) > (-2.0, 0) ORDER BY score, doc_id LIMIT 20",
    "bm25_phrase": f"WITH {_score('documents', 'doc_id', 'text', _PH)} SELECT doc_id, score FROM ranked",
    "bm25_index": f"WITH {_score('documents', 'doc_id', 'text', _PH)} SELECT doc_id, score FROM ranked",
    "bm25_scan": f"WITH {_score('documents', 'doc_id', 'text', _PH)} SELECT doc_id, score FROM ranked",
    "summary_then_evidence_search": f"""WITH s AS (SELECT DISTINCT id, content FROM summaries), c AS (SELECT DISTINCT id, content FROM chunks),
a AS (WITH {_score('s', 'id', 'content', ['refresh', 'job'])} SELECT 0 AS domain, id AS source_id, score FROM ranked), b AS (WITH {_score('c', 'id', 'content', ['refresh', 'job'])} SELECT 1 AS domain, id AS source_id, score FROM ranked)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY domain, score, source_id LIMIT 100""",
    "index_terms": f"WITH t AS (SELECT doc_id, unnest({_T.format('text')}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM p GROUP BY term",
    "like_fallback": "SELECT DISTINCT id, substr(content, 1, 700) AS preview FROM chunks WHERE content ILIKE '%checksum%' OR content ILIKE '%passphrase%'",
    "coverage_rank": f"""WITH d AS (SELECT doc_id, {_T.format('text')} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, (4 * list_contains(t, 'evidence')::INT + 4 * list_contains(t, 'claim')::INT + 4 * list_contains(t, 'stale')::INT + 12 * list_contains(t, 'zituprax')::INT) / 24.0 AS coverage FROM d)
SELECT doc_id, round(coverage * 1000 - least(100.0, n / 100.0), 6) AS score FROM c WHERE coverage > 0""",
    "compact_retrieve": f"WITH {_score('documents', 'doc_id', 'text', ['parser', 'budget'])} SELECT doc_id, source, score, rel_path, lang, n_chars FROM ranked ORDER BY score, doc_id LIMIT 20",
}
