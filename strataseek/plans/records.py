"""Queries over the record tables: orphan references (problem 1) and snapshot changes (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions.text import instant, json_strings, slugify, strip
from strataseek.operators import references, snapshots
from strataseek.runtime import table


def summary_references(summaries: DataFrame) -> DataFrame:
    """References of summaries in long form: summary_id, ref_field, ref_table, ref_id, ref_at, distinct.

    evidence_ids give their non-empty strings, trimmed, lower case, without
    ``kb://evidence/``; target_id gives its slug for projects, concepts and
    files, and nothing for other types. Rows delivered again count once.
    """
    s = summaries.select(F.col("id").alias("summary_id"), "target_type", "target_id", "evidence_ids", instant(F.col("created_at")).alias("ref_at"))
    item = F.regexp_replace(F.lower(strip(F.col("item"))), r"^kb://evidence/", "")
    cited = s.select("summary_id", F.lit("evidence_ids").alias("ref_field"), F.lit("evidence").alias("ref_table"), F.explode(json_strings(F.col("evidence_ids"))).alias("item"), "ref_at")
    cited = cited.withColumn("ref_id", item).where("ref_id <> ''").drop("item")
    aimed = s.where("target_type IN ('project', 'concept', 'file') AND target_id IS NOT NULL").select("summary_id", F.lit("target_id").alias("ref_field"), F.col("target_type").alias("ref_table"), slugify(F.col("target_id")).alias("ref_id"), "ref_at")
    return cited.unionByName(aimed).distinct()


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may be referred to: ref_table, ref_id, valid_from, valid_to."""
    never = F.lit(None).cast("timestamp")
    ids = lambda name, kind, since, until: table(spark, sf_dir, name).select(F.lit(kind).alias("ref_table"), F.col("id").cast("string").alias("ref_id"), since.alias("valid_from"), until.alias("valid_to"))
    return (
        ids("evidence_occurrences", "evidence", F.col("recorded_at"), F.col("revoked_at"))
        .unionByName(ids("projects", "project", F.col("registered_at"), F.col("removed_at")))
        .unionByName(ids("concepts", "concept", F.col("registered_at"), F.col("removed_at")))
        .unionByName(ids("files", "file", never, never))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = summary_references(table(spark, sf_dir, "summaries"))
    return references.orphans(refs, registered(spark, sf_dir)).select("summary_id", "ref_field", "ref_id").distinct()


def p1_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(summary_references(table(spark, sf_dir, "summaries")), registered(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.file_changes(table(spark, sf_dir, "scan_jobs"), table(spark, sf_dir, "file_snapshots"))


def p5_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("project_id", "scan_no", "change_type").agg(F.count("*").alias("n_files"))


QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p5_found": p5_found, "p5_change_counts": p5_change_counts}

_P1 = r"""
WITH s AS (SELECT DISTINCT id, target_type, target_id, evidence_ids, created_at::TIMESTAMPTZ AS t FROM summaries),
items AS (SELECT id, t, unnest(json_extract(evidence_ids, '$[*]')) AS j FROM s WHERE json_valid(evidence_ids) AND json_type(evidence_ids) = 'ARRAY'),
cited AS (SELECT DISTINCT id AS summary_id, 'evidence_ids' AS ref_field, 'evidence' AS ref_table, regexp_replace(lower(trim(json_extract_string(j, '$'))), '^kb://evidence/', '') AS ref_id, t FROM items WHERE json_type(j) = 'VARCHAR'),
slugs AS (SELECT DISTINCT id, target_type, t, lower(regexp_replace(regexp_replace(regexp_replace(replace(trim(target_id), '\', '/'), '^.*/', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g')) AS x FROM s WHERE target_type IN ('project', 'concept', 'file')),
refs AS (SELECT * FROM cited WHERE ref_id <> '' UNION SELECT id, 'target_id', target_type, CASE WHEN x = '' THEN 'item' ELSE x END, t FROM slugs),
parents AS (
  SELECT 'evidence' AS ref_table, id AS ref_id, min(recorded_at) AS since, min(revoked_at) AS until FROM evidence_occurrences GROUP BY ALL
  UNION ALL SELECT 'project', id, min(registered_at), min(removed_at) FROM projects GROUP BY ALL
  UNION ALL SELECT 'concept', id, min(registered_at), min(removed_at) FROM concepts GROUP BY ALL
  UNION ALL SELECT DISTINCT 'file', id::VARCHAR, NULL::TIMESTAMPTZ, NULL::TIMESTAMPTZ FROM files),
cases AS (SELECT r.*, CASE WHEN p.ref_id IS NULL THEN 'missing' WHEN r.t < p.since THEN 'later' WHEN r.t >= p.until THEN 'ended' END AS reason
  FROM refs r LEFT JOIN parents p ON r.ref_table = p.ref_table AND r.ref_id = p.ref_id)
"""

_P5 = r"""
WITH jobs AS (SELECT project_id, scan_no, row_number() OVER (PARTITION BY project_id ORDER BY scan_no) AS k FROM (SELECT DISTINCT project_id, scan_no FROM scan_jobs WHERE state = 'committed')),
rows AS (SELECT j.project_id, j.k, lower(regexp_replace(replace(rel_path, '\', '/'), '^(\./)+', '')) AS rel_path, loaded_at, lower(trim(sha256)) AS h, size, floor(mtime) AS m FROM file_snapshots f JOIN jobs j ON f.project_id = j.project_id AND f.scan_no = j.scan_no),
last AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY project_id, k, rel_path ORDER BY loaded_at DESC) = 1),
pairs AS (
  SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.rel_path, b.rel_path) AS rel_path, coalesce(b.k, a.k + 1) AS k,
    CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h <> b.h OR ((a.h IS NULL OR b.h IS NULL) AND (a.size <> b.size OR a.m <> b.m)) THEN 'changed' END AS change_type
  FROM last a FULL JOIN last b ON a.project_id = b.project_id AND a.rel_path = b.rel_path AND b.k = a.k + 1),
events AS (SELECT j.scan_no, p.project_id, p.rel_path, p.change_type FROM pairs p JOIN jobs j ON p.project_id = j.project_id AND p.k = j.k WHERE p.change_type IS NOT NULL AND p.k > 1)
"""

ORACLES = {
    "p1_found": _P1 + "SELECT DISTINCT summary_id, ref_field, ref_id FROM cases WHERE reason IS NOT NULL",
    "p1_orphan_report": _P1 + "SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, reason, count(*) AS n_orphans FROM cases WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _P5 + "SELECT scan_no, project_id, rel_path, change_type FROM events",
    "p5_change_counts": _P5 + "SELECT project_id, scan_no, change_type, count(*) AS n_files FROM events GROUP BY ALL",
}
