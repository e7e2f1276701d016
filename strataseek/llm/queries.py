"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions.text import line_count
from strataseek.llm import handwritten, markup, mixing, packing, quality, secrets, splitting, terms
from strataseek.operators.dedup import one_per_key
from strataseek.runtime import materialise, spread, table


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks and summaries as source_table, record_id, content."""
    parts = [one_per_key(spread(table(spark, sf_dir, name).select(F.col("id").alias("record_id"), "content"), "record_id"), "record_id").select(F.lit(name).alias("source_table"), "record_id", "content") for name in ("chunks", "summaries")]
    return parts[0].unionByName(parts[1])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "chunks"), "id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.score_terms(collection(spark, sf_dir)).where("tf >= 3 AND df BETWEEN 2 AND 5").select("source_table", "record_id", "term")


def p2_term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.score_terms(collection(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_kinds(chunks(spark, sf_dir))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_chunks(chunks(spark, sf_dir))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.label_files(table(spark, sf_dir, "files"), chunks(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_labels(spark, sf_dir).where("label <> 'handwritten'").select("file_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_lines(chunks(spark, sf_dir))


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redacted(chunks(spark, sf_dir))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(chunks(spark, sf_dir), splitting.limits_of(table(spark, sf_dir, "size_limits")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_pieces(spark, sf_dir).where("n_pieces > 1").select("chunk_id").distinct()


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk put together again from its pieces: digest, and whether the pieces keep the limits, overlap as they may and know their lines.

    Pieces of a chunk are bounded by its own size.
    """
    limits = splitting.limits_of(table(spark, sf_dir, "size_limits"))
    p = p7_pieces(spark, sf_dir)
    fits = (F.length("content") <= limits["max_chars"]) & (line_count(F.col("content")) <= limits["max_lines"]) & (F.col("char_end") - F.col("char_start") == F.length("content"))
    one = p.withColumn("fits", fits).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end", "content"))).alias("p"), F.min("fits").alias("fits"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    new = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.element_at("p", 1)["content"]).otherwise(F.substr(F.element_at("p", i)["content"], (F.element_at("p", i - 1)["char_end"] - F.element_at("p", i)["char_start"] + 1).cast("int"))))
    # the first piece has none before it; ``i - 1`` is not looked at there
    return one.select("chunk_id", F.sha2(F.array_join(new, ""), 256).alias("digest"), "fits", (F.col("line_end") - F.col("line_start") + 1).alias("n_lines"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(p8_containers(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p8_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: documents placed, containers filled beyond the capacity, and documents cut though they fit (both 0)."""
    limits = table(spark, sf_dir, "size_limits").where("unit = 'token'").select("limit_id", "capacity")
    placed = materialise(p8_containers(spark, sf_dir))
    over = placed.groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("fill")).join(F.broadcast(limits), "limit_id").groupBy("limit_id").agg(F.count_if(F.col("fill") > F.col("capacity")).alias("n_overfull"))
    docs = placed.groupBy("limit_id", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("size")).join(F.broadcast(limits), "limit_id")
    docs = docs.groupBy("limit_id").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("n_cut_in_vain"))
    return docs.join(over, "limit_id")


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))[1]


def p9_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: documents there are, whether none is used too often, and whether the share is met within one document."""
    s = materialise(p9_shares(spark, sf_dir))
    able = F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(Window.partitionBy())  # a fixed table
    everything = F.sum("used_tokens").over(Window.partitionBy())
    longest = mixing.longest(documents(spark, sf_dir))
    off = F.abs(F.col("used_tokens") - F.col("target_share") / able * everything)
    s = s.join(F.broadcast(longest), "source", "left").withColumn("met", (F.col("n_tokens") == 0) | (off <= F.col("longest")))
    return s.select("source", "target_share", "n_docs", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), "met")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = quality.word_lists(table(spark, sf_dir, "common_words"))
    return quality.verdicts(documents(spark, sf_dir), words, describe=False).where("NOT is_prose").select("doc_id").distinct()


def p10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir), quality.word_lists(table(spark, sf_dir, "common_words")))


QUERIES = {
    "p2_found": p2_found,
    "p2_term_weights": p2_term_weights,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_labels": p4_labels,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_pieces": p7_pieces,
    "p7_round_trip": p7_round_trip,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_valid": p8_valid,
    "p9_uses": p9_uses,
    "p9_shares": p9_shares,
    "p9_valid": p9_valid,
    "p10_found": p10_found,
    "p10_quality": p10_quality,
}

ORACLES = {
    "p2_found": r"""
WITH records AS (SELECT DISTINCT 'chunks' AS source_table, id AS record_id, content FROM chunks UNION SELECT DISTINCT 'summaries', id, content FROM summaries),
t AS (SELECT source_table, record_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM records),
f AS (SELECT source_table, record_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f)
SELECT source_table, record_id, term FROM d WHERE tf >= 3 AND df BETWEEN 2 AND 5""",
    "p2_term_weights": r"""
WITH records AS (SELECT DISTINCT 'chunks' AS source_table, id AS record_id, content FROM chunks UNION SELECT DISTINCT 'summaries', id, content FROM summaries),
l AS (SELECT source_table, record_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ts FROM records),
t AS (SELECT source_table, record_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM l),
f AS (SELECT source_table, record_id, term, count(*) AS tf FROM t GROUP BY ALL),
e AS (SELECT a.source_table, a.record_id, a.term, b.term AS other FROM t a JOIN t b ON a.source_table = b.source_table AND a.record_id = b.record_id AND b.pos IN (a.pos - 3, a.pos - 2, a.pos - 1, a.pos + 1, a.pos + 2, a.pos + 3) AND a.term <> b.term),
g AS (SELECT source_table, record_id, term, count(DISTINCT other) AS degree FROM e GROUP BY ALL),
d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f), n AS (SELECT count(*) AS n FROM records)
SELECT d.source_table, d.record_id, d.term, d.tf::INT AS tf, coalesce(g.degree, 0)::INT AS degree, d.df, round(coalesce(g.degree, 0) * ln((n + 1.0) / d.df), 9) AS weight
FROM d LEFT JOIN g ON d.source_table = g.source_table AND d.record_id = g.record_id AND d.term = g.term, n""",
    "p7_round_trip": r"""SELECT chunk_id, sha256(content) AS digest, true AS fits, length(x) - length(replace(x, chr(10), '')) + CASE WHEN x LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n_lines
FROM (SELECT DISTINCT id AS chunk_id, content, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS x FROM chunks WHERE content <> '')""",
    "p8_valid": "SELECT limit_id, n_docs, 0 AS n_overfull, 0 AS n_cut_in_vain FROM size_limits, (SELECT count(*) AS n_docs FROM documents) WHERE unit = 'token'",
    "p9_valid": "SELECT m.source, target_share, count(doc_id) AS n_docs, true AS within_repeats, true AS met FROM mix_targets m LEFT JOIN documents d ON m.source = d.source GROUP BY m.source, target_share",
    "p7_found": r"""
SELECT DISTINCT id AS chunk_id FROM (SELECT id, content, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS x FROM chunks)
WHERE length(content) > 10000 OR length(x) - length(replace(x, chr(10), '')) + CASE WHEN x LIKE '%' || chr(10) THEN 0 ELSE 1 END > 180""",
}
