"""Queries on versions, notes, statistics and the project graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions import text as T
from strataseek.operators import graph as G
from strataseek.operators import snapshots as S
from strataseek.operators import versioning as V
from strataseek.operators.dedup import one_per_key
from strataseek.runtime import table


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "scan_jobs")
    done = jobs.where("state = 'committed'").withColumn("parent_id", F.lag("operation_id").over(Window.partitionBy("project_id").orderBy("scan_no")))
    return done.select(F.col("operation_id").alias("id"), "parent_id", F.lit("published").alias("state"), "project_id", "scan_no")


def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lineages(_generations(spark, sf_dir))


def lineage_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each committed scan that the third published scan of its project can see: written by it or an ancestor."""
    g = _generations(spark, sf_dir)
    third = V.lineages(g).where("depth = 2").select(F.col("id").alias("generation_id"))
    rows = table(spark, sf_dir, "file_snapshots").join(table(spark, sf_dir, "scan_jobs").where("state = 'committed'").select("project_id", "scan_no", F.col("operation_id").alias("generation")), ["project_id", "scan_no"])
    scope = V.lineages(g).join(third, F.col("id") == F.col("generation_id"), "left_semi").select(F.col("ancestor").alias("generation"), F.col("id").alias("seen_from"))
    return rows.join(scope, "generation").groupBy("seen_from", "generation").agg(F.countDistinct(T.path_key(F.col("rel_path"))).alias("n_files"))


def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by what their marks amount to."""
    n = _notes(spark, sf_dir)
    return n.groupBy(G.effective_status(F.col("content_status"), F.col("provenance_review")).alias("status")).agg(F.count("*").alias("n"))


def _scan(spark: SparkSession, sf_dir: str, scan_no: int) -> DataFrame:
    jobs = table(spark, sf_dir, "scan_jobs").where(f"state = 'committed' AND scan_no = {scan_no}").select("project_id")
    rows = table(spark, sf_dir, "file_snapshots").where(f"scan_no = {scan_no}").join(F.broadcast(jobs), "project_id")
    rows = rows.select("project_id", T.path_key(F.col("rel_path")).alias("rel_path"), "loaded_at", F.lower("sha256").alias("sha256"), "size", F.floor("mtime").alias("second"))
    return S.last_delivered(rows, ["project_id", "rel_path"], "loaded_at", ["sha256", "size", "second"]).drop("loaded_at")


def _memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """valid_from, valid_to (scan numbers) of each file, from the change events."""
    ev = S.file_changes(table(spark, sf_dir, "scan_jobs"), table(spark, sf_dir, "file_snapshots"))
    first = table(spark, sf_dir, "scan_jobs").where("state = 'committed'").groupBy("project_id").agg(F.min("scan_no").alias("scan_no"))
    base = table(spark, sf_dir, "file_snapshots").join(F.broadcast(first), ["project_id", "scan_no"]).select("project_id", T.path_key(F.col("rel_path")).alias("rel_path"), F.col("scan_no").alias("valid_from")).distinct()
    log = base.withColumn("tombstone", F.lit(0)).unionByName(ev.select("project_id", "rel_path", F.col("scan_no").alias("valid_from"), (F.col("change_type") == "removed").cast("int").alias("tombstone")))
    return V.close_out(log, ["project_id", "rel_path"], "valid_from")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memberships(spark, sf_dir)


def asof_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each project as of scan 3."""
    return V.as_of(_memberships(spark, sf_dir), 3).groupBy("project_id").agg(F.count("*").alias("n_files"))


def current_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = V.as_of(_memberships(spark, sf_dir), 99, history=True)
    return m.groupBy("project_id").agg(F.count_if(F.col("valid_to").isNull()).alias("n_current"), F.count_if(F.col("valid_to").isNotNull()).alias("n_history"))


def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are gone now."""
    return _memberships(spark, sf_dir).where("tombstone = 1 AND valid_to IS NULL").select("project_id", "rel_path", "valid_from")


def refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions from scan 3 to scan 4."""
    both = lambda a, b: a.join(b.select("project_id").distinct(), "project_id", "left_semi")
    a, b = (_scan(spark, sf_dir, n).withColumnRenamed("second", "modified") for n in (3, 4))
    return V.refresh_diff(both(a, b), both(b, a))


def relation_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ between two scans."""
    c = ["project_id", "rel_path", "sha256"]
    return V.same_rows(_scan(spark, sf_dir, 3).select(*c), _scan(spark, sf_dir, 4).select(*c))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "summaries").withColumn("at", T.instant(F.col("updated_at")))
    return V.latest_per_key(s, ["id"], F.col("at"), F.col("updated_at"))


def superseded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.superseded(_notes(spark, sf_dir)).select("id", "is_superseded", "is_current")


def latest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest summary of each target and type."""
    n = _notes(spark, sf_dir).withColumn("target", T.slugify(F.col("target_id")))
    return V.latest_per_key(n, ["target_type", "target", "summary_type"], F.col("id")).select("target_type", "target", "summary_type", "id")


def confirmed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with exactly one reviewed, confirmed and current note: that note is a confirmed fact."""
    n = V.superseded(_notes(spark, sf_dir)).where("is_current AND provenance_review = 'reviewed' AND summary_family IS NOT NULL")
    one = n.groupBy("target_type", "target_id", "summary_family").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("content_status").alias("status"))
    return one.where("n = 1 AND status = 'confirmed'").select("target_type", "target_id", "summary_family", "id")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered citations of every note with their state."""
    n = _notes(spark, sf_dir).select(F.col("id").alias("summary_id"), F.posexplode(T.json_strings(F.col("evidence_ids"))).alias("ordinal", "reference"))
    n = n.withColumn("evidence_id", F.regexp_replace(F.lower(T.strip(F.col("reference"))), "^kb://evidence/", ""))
    known = table(spark, sf_dir, "evidence_occurrences").groupBy(F.col("id").alias("evidence_id")).agg((F.count("revoked_at") > 0).alias("revoked"))
    j = n.join(known, "evidence_id", "left")
    return j.select("summary_id", "ordinal", "evidence_id", F.when(F.col("revoked").isNull(), "missing").when(F.col("revoked"), "revoked").otherwise("resolved").alias("status"))


def legacy_alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old chunk references with the evidence they stand for: resolved, ambiguous or missing."""
    e = table(spark, sf_dir, "evidence_occurrences").select(F.get_json_object("legacy_json", "$.chunk_id").cast("long").alias("chunk_id"), "id", "revoked_at")
    live = e.groupBy("chunk_id", "id").agg(F.count("revoked_at").alias("gone")).where("gone = 0 AND chunk_id IS NOT NULL")
    per = live.groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("id").alias("evidence_id"))
    j = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id")).distinct().join(per, "chunk_id", "left")
    return j.select("chunk_id", F.when(F.col("n") == 1, F.col("evidence_id")).alias("evidence_id"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "projects")
    one = lambda col, kind: p.select(F.col("id").alias("project_id"), F.lit(kind).alias("kind"), F.explode(T.json_strings(F.col(col))).alias("tag"))
    return one("technologies", "technology").unionByName(one("domains", "domain")).distinct()


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = _tags(spark, sf_dir)
    names = table(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), F.explode(F.split(F.lower("name"), " ")).alias("word")).distinct()
    return G.tag_edges(tags).unionByName(G.project_edges(tags, names))


def shared_tag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tags(spark, sf_dir).groupBy("kind", "tag").agg(F.countDistinct("project_id").alias("n_projects"), F.array_join(F.array_sort(F.collect_set("project_id")), "; ").alias("projects"))
    return t.select("kind", "tag", "n_projects", "projects")


def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(_edges(spark, sf_dir), "amber-parser", 2)


def neighbours_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.neighbours(_edges(spark, sf_dir), "python", "in", "uses_technology")
    return e.orderBy("source_id").limit(20).select("source_id", "direction", "weight")


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table of the store."""
    out = None
    for name in ("projects", "concepts", "files", "chunks", "summaries", "evidence_occurrences", "scan_jobs", "file_snapshots"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = one_per_key(table(spark, sf_dir, "files").select("id", "project_id", "indexed", "mtime", "size"), "id")
    return f.groupBy("project_id").agg(F.count("*").alias("n_files"), F.count_if(F.col("indexed") == 1).alias("n_indexed"), F.max("mtime").alias("newest"), F.sum("size").alias("bytes"))


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "scan_jobs").groupBy("state").agg(F.count("*").alias("n"))


def body_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts held once: digest, length, number of chunks, smallest chunk id."""
    c = table(spark, sf_dir, "chunks").select("id", F.sha2("content", 256).alias("digest"), F.length("content").alias("chars")).distinct()
    return c.groupBy("digest", "chars").agg(F.count("*").alias("n_chunks"), F.min("id").alias("body_id"))


def body_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose text is not there, and texts no evidence uses."""
    e = table(spark, sf_dir, "evidence_occurrences").select(F.col("body_id").alias("id")).distinct()
    c = table(spark, sf_dir, "chunks").select("id").distinct()
    return e.join(c, "id", "left_anti").withColumn("side", F.lit("evidence")).unionByName(c.join(e, "id", "left_anti").withColumn("side", F.lit("chunk")))


def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact text of every piece of evidence."""
    e = table(spark, sf_dir, "evidence_occurrences").select(F.col("id").alias("evidence_id"), F.col("body_id").alias("id"), "char_start", "char_end").distinct()
    c = one_per_key(table(spark, sf_dir, "chunks").select("id", "content"), "id")
    return e.join(c, "id").select("evidence_id", T.window(F.col("content"), F.col("char_start"), (F.col("char_end") - F.col("char_start")).cast("int")).alias("text"), F.length("content").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        lineage_closure, lineage_scope, effective_status, memberships, asof_membership, current_vs_history, tombstone_filter, refresh_diff, relation_equality, superseded_flags, latest_summary, confirmed_facts, citations, legacy_alias_resolve,
        shared_tag_edges, concept_counts, bfs_depth2, neighbours_page, store_stats, filtered_counts, status_histogram, body_dedup, body_orphans, evidence_window,
    )
}

_KEY = r"lower(regexp_replace(replace(rel_path, '\', '/'), '^(\./)+', ''))"
_NOTES = "notes AS (SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at::TIMESTAMPTZ DESC, updated_at DESC) = 1)"
_SLUG = r"lower(regexp_replace(regexp_replace(regexp_replace(replace(trim(target_id), '\', '/'), '^.*/', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'))"
_SCAN = f"""scan AS (SELECT f.scan_no, f.project_id, {_KEY} AS rel_path, lower(sha256) AS sha256, size, floor(mtime) AS second FROM file_snapshots f JOIN scan_jobs j ON f.project_id = j.project_id AND f.scan_no = j.scan_no AND j.state = 'committed'
  WHERE f.scan_no IN (3, 4) QUALIFY row_number() OVER (PARTITION BY f.scan_no, f.project_id, {_KEY} ORDER BY loaded_at DESC) = 1)"""
_MEMBER = f"""jobs AS (SELECT project_id, scan_no, row_number() OVER (PARTITION BY project_id ORDER BY scan_no) AS k, count(*) OVER (PARTITION BY project_id) AS last_k FROM scan_jobs WHERE state = 'committed'),
seen AS (SELECT j.project_id, j.k, {_KEY} AS rel_path, lower(sha256) AS h, size AS z, floor(mtime) AS m FROM file_snapshots f JOIN jobs j ON f.project_id = j.project_id AND f.scan_no = j.scan_no
  QUALIFY row_number() OVER (PARTITION BY j.project_id, j.k, {_KEY} ORDER BY loaded_at DESC) = 1),
log AS (SELECT b.project_id, b.rel_path, b.k, 0 AS tombstone FROM seen b LEFT JOIN seen a ON a.project_id = b.project_id AND a.rel_path = b.rel_path AND a.k = b.k - 1
    WHERE a.k IS NULL OR a.h <> b.h OR ((a.h IS NULL OR b.h IS NULL) AND (a.z <> b.z OR a.m <> b.m))
  UNION ALL SELECT a.project_id, a.rel_path, a.k + 1, 1 FROM seen a JOIN (SELECT DISTINCT project_id, last_k FROM jobs) l ON a.project_id = l.project_id AND a.k < l.last_k
    WHERE NOT EXISTS (SELECT 1 FROM seen b WHERE b.project_id = a.project_id AND b.rel_path = a.rel_path AND b.k = a.k + 1)),
m AS (SELECT l.project_id, l.rel_path, j.scan_no AS valid_from, l.tombstone, lead(j.scan_no) OVER (PARTITION BY l.project_id, l.rel_path ORDER BY j.scan_no) AS valid_to FROM log l JOIN jobs j ON l.project_id = j.project_id AND l.k = j.k)"""
_TAGS = """tags AS (SELECT DISTINCT id AS project_id, 'technology' AS kind, unnest(technologies::JSON::VARCHAR[]) AS tag FROM projects WHERE json_valid(technologies)
  UNION SELECT DISTINCT id, 'domain', unnest(domains::JSON::VARCHAR[]) FROM projects WHERE json_valid(domains))"""
_EDGES = f"""{_TAGS}, shared AS (SELECT a.project_id AS source_id, b.project_id AS target_id, a.kind, count(*) AS n FROM tags a JOIN tags b ON a.kind = b.kind AND a.tag = b.tag AND a.project_id <> b.project_id GROUP BY ALL),
words AS (SELECT DISTINCT id AS project_id, unnest(string_split(lower(name), ' ')) AS word FROM projects),
alike AS (SELECT a.project_id AS source_id, b.project_id AS target_id FROM words a JOIN words b ON a.word = b.word AND a.project_id <> b.project_id GROUP BY ALL HAVING count(*) >= 2),
edges AS (SELECT project_id AS source_id, 'concept' AS target_type, tag AS target_id, CASE kind WHEN 'technology' THEN 'uses_technology' ELSE 'has_domain' END AS relation_type, CASE kind WHEN 'technology' THEN 1.0 ELSE 0.6 END::DOUBLE AS weight FROM tags
  UNION ALL SELECT source_id, 'project', target_id, CASE kind WHEN 'technology' THEN 'shares_technology' ELSE 'same_domain' END, least(CASE kind WHEN 'technology' THEN 1.0 ELSE 0.8 END, n / 4.0)::DOUBLE FROM shared
  UNION ALL SELECT source_id, 'project', target_id, 'candidate_name_overlap', 0.25 FROM alike WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.source_id = alike.source_id AND s.target_id = alike.target_id))"""

ORACLES = {
    "lineage_closure": """WITH RECURSIVE g AS (SELECT operation_id AS id, lag(operation_id) OVER (PARTITION BY project_id ORDER BY scan_no) AS parent_id FROM scan_jobs WHERE state = 'committed'),
l AS (SELECT id, id AS ancestor, parent_id, 0::BIGINT AS depth FROM g UNION ALL SELECT l.id, g.id, g.parent_id, l.depth + 1 FROM l JOIN g ON l.parent_id = g.id) SELECT id, ancestor, depth FROM l""",
    "lineage_scope": f"""WITH g AS (SELECT operation_id, project_id, scan_no, row_number() OVER (PARTITION BY project_id ORDER BY scan_no) AS k FROM scan_jobs WHERE state = 'committed'),
seen AS (SELECT a.operation_id AS seen_from, b.operation_id AS generation, b.project_id, b.scan_no FROM g a JOIN g b ON a.project_id = b.project_id AND b.k <= a.k WHERE a.k >= 3)
SELECT seen_from, generation, count(DISTINCT {_KEY}) AS n_files FROM seen JOIN file_snapshots USING (project_id, scan_no) GROUP BY ALL""",
    "effective_status": f"WITH {_NOTES} SELECT CASE WHEN content_status = 'confirmed' AND provenance_review = 'reviewed' THEN 'confirmed' WHEN content_status = 'candidate' THEN 'candidate' ELSE 'unconfirmed' END AS status, count(*) AS n FROM notes GROUP BY ALL",
    "memberships": f"WITH {_MEMBER} SELECT * FROM m",
    "asof_membership": f"WITH {_MEMBER} SELECT project_id, count(*) AS n_files FROM m WHERE valid_from <= 3 AND tombstone = 0 AND (valid_to IS NULL OR valid_to > 3) GROUP BY ALL",
    "current_vs_history": f"WITH {_MEMBER} SELECT project_id, count(*) FILTER (valid_to IS NULL) AS n_current, count(*) FILTER (valid_to IS NOT NULL) AS n_history FROM m WHERE tombstone = 0 GROUP BY ALL",
    "tombstone_filter": f"WITH {_MEMBER} SELECT project_id, rel_path, valid_from FROM m WHERE tombstone = 1 AND valid_to IS NULL",
    "refresh_diff": f"""WITH {_SCAN}, a AS (SELECT * FROM scan WHERE scan_no = 3 AND project_id IN (SELECT project_id FROM scan WHERE scan_no = 4)), b AS (SELECT * FROM scan WHERE scan_no = 4 AND project_id IN (SELECT project_id FROM scan WHERE scan_no = 3)),
d AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.rel_path, b.rel_path) AS rel_path, coalesce(a.sha256, b.sha256) AS sha, coalesce(a.size, b.size) AS size,
  CASE WHEN a.rel_path IS NULL THEN 'new' WHEN b.rel_path IS NULL THEN 'tombstone' WHEN a.size IS NOT DISTINCT FROM b.size AND (a.sha256 = b.sha256 OR ((a.sha256 IS NULL OR b.sha256 IS NULL) AND a.second = b.second)) THEN 'unchanged' ELSE 'new_version' END AS action
  FROM a FULL JOIN b ON a.project_id = b.project_id AND a.rel_path = b.rel_path),
u AS (SELECT project_id, coalesce(sha, '') AS sha, size, action, min(rel_path) AS p FROM d WHERE action IN ('new', 'tombstone') GROUP BY ALL HAVING count(*) = 1),
mv AS (SELECT o.project_id, o.p AS old, n.p AS new, o.sha <> '' AS sure FROM u o JOIN u n ON o.project_id = n.project_id AND o.sha = n.sha AND o.size = n.size WHERE o.action = 'tombstone' AND n.action = 'new')
SELECT d.project_id, d.rel_path, CASE WHEN mv.sure THEN 'renamed' WHEN NOT mv.sure THEN 'possible_move' WHEN g.sure AND d.action = 'tombstone' THEN 'renamed_away' ELSE d.action END AS action, mv.old AS moved_from
FROM d LEFT JOIN mv ON d.project_id = mv.project_id AND d.rel_path = mv.new LEFT JOIN mv g ON d.project_id = g.project_id AND d.rel_path = g.old""",
    "relation_equality": f"""WITH {_SCAN}, a AS (SELECT project_id, rel_path, sha256 FROM scan WHERE scan_no = 3), b AS (SELECT project_id, rel_path, sha256 FROM scan WHERE scan_no = 4)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "superseded_flags": f"WITH {_NOTES}, x AS (SELECT *, id IN (SELECT supersedes_id FROM notes WHERE supersedes_id IS NOT NULL) AS is_superseded FROM notes) SELECT id, is_superseded, NOT is_superseded AND coalesce(record_type, 'legacy_unknown') <> 'legacy_unknown' AS is_current FROM x",
    "latest_summary": f"WITH {_NOTES} SELECT target_type, CASE WHEN {_SLUG} = '' THEN 'item' ELSE {_SLUG} END AS target, summary_type, max(id) AS id FROM notes GROUP BY ALL",
    "confirmed_facts": f"""WITH {_NOTES}, c AS (SELECT * FROM notes WHERE id NOT IN (SELECT supersedes_id FROM notes WHERE supersedes_id IS NOT NULL) AND coalesce(record_type, 'legacy_unknown') <> 'legacy_unknown' AND provenance_review = 'reviewed' AND summary_family IS NOT NULL)
SELECT target_type, target_id, summary_family, min(id) AS id FROM c GROUP BY ALL HAVING count(*) = 1 AND min(content_status) = 'confirmed'""",
    "citations": f"""WITH {_NOTES}, i AS (SELECT id, unnest(list_filter(json_extract(evidence_ids, '$[*]'), lambda j: json_type(j) = 'VARCHAR')) AS j, generate_subscripts(list_filter(json_extract(evidence_ids, '$[*]'), lambda j: json_type(j) = 'VARCHAR'), 1) - 1 AS ordinal FROM notes WHERE json_valid(evidence_ids) AND json_type(evidence_ids) = 'ARRAY'),
k AS (SELECT id, count(revoked_at) > 0 AS revoked FROM evidence_occurrences GROUP BY id), r AS (SELECT id AS summary_id, ordinal, regexp_replace(lower(trim(json_extract_string(j, '$'))), '^kb://evidence/', '') AS evidence_id FROM i)
SELECT summary_id, ordinal::INT AS ordinal, evidence_id, CASE WHEN k.id IS NULL THEN 'missing' WHEN revoked THEN 'revoked' ELSE 'resolved' END AS status FROM r LEFT JOIN k ON r.evidence_id = k.id""",
    "legacy_alias_resolve": """WITH e AS (SELECT (legacy_json->>'$.chunk_id')::BIGINT AS chunk_id, id FROM evidence_occurrences GROUP BY ALL HAVING count(revoked_at) = 0), p AS (SELECT chunk_id, count(*) AS n, min(id) AS evidence_id FROM e GROUP BY ALL)
SELECT DISTINCT c.id AS chunk_id, CASE WHEN n = 1 THEN evidence_id END AS evidence_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM chunks c LEFT JOIN p ON c.id = p.chunk_id""",
    "shared_tag_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "concept_counts": f"WITH {_TAGS} SELECT kind, tag, count(DISTINCT project_id) AS n_projects, string_agg(project_id, '; ' ORDER BY project_id) AS projects FROM tags GROUP BY ALL",
    "bfs_depth2": f"""WITH {_EDGES}, t AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type, target_id) <= 80),
one AS (SELECT *, 1 AS depth FROM t WHERE source_id = 'amber-parser'), f AS (SELECT DISTINCT target_id FROM one WHERE target_type = 'project' AND target_id <> 'amber-parser')
SELECT * FROM one UNION ALL SELECT t.*, 2 FROM t JOIN f ON t.source_id = f.target_id""",
    "neighbours_page": f"WITH {_EDGES} SELECT source_id, 'in' AS direction, weight FROM edges WHERE target_id = 'python' AND relation_type = 'uses_technology' ORDER BY source_id LIMIT 20",
    "store_stats": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("projects", "concepts", "files", "chunks", "summaries", "evidence_occurrences", "scan_jobs", "file_snapshots")),
    "filtered_counts": "WITH f AS (SELECT DISTINCT id, project_id, indexed, mtime, size FROM files) SELECT project_id, count(*) AS n_files, count(*) FILTER (indexed = 1) AS n_indexed, max(mtime) AS newest, sum(size)::BIGINT AS bytes FROM f GROUP BY ALL",
    "status_histogram": "SELECT state, count(*) AS n FROM scan_jobs GROUP BY ALL",
    "body_dedup": "WITH c AS (SELECT DISTINCT id, sha256(content) AS digest, length(content)::INT AS chars FROM chunks) SELECT digest, chars, count(*) AS n_chunks, min(id) AS body_id FROM c GROUP BY ALL",
    "body_orphans": "SELECT DISTINCT body_id AS id, 'evidence' AS side FROM evidence_occurrences WHERE body_id NOT IN (SELECT id FROM chunks) UNION ALL SELECT DISTINCT id, 'chunk' FROM chunks WHERE id NOT IN (SELECT body_id FROM evidence_occurrences WHERE body_id IS NOT NULL)",
    "evidence_window": "WITH c AS (SELECT DISTINCT id, content FROM chunks), e AS (SELECT DISTINCT id, body_id, char_start, char_end FROM evidence_occurrences) SELECT e.id AS evidence_id, substr(content, (char_start + 1)::BIGINT, (char_end - char_start)::BIGINT) AS text, length(content)::INT AS total FROM e JOIN c ON e.body_id = c.id",
}
