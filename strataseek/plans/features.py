"""Queries on project features, audits, imports and the finer tokenizer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataseek.functions import paths as P
from strataseek.functions import text as T
from strataseek.operators import versioning as V
from strataseek.operators.dedup import one_per_key
from strataseek.runtime import spread, table

CONFIGS = ["package.json", "pyproject.toml", "vite.config.ts"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(table(spark, sf_dir, "files").select("id", "project_id", "rel_path", "size", "indexed", "skipped_reason", "mtime"), "id").withColumn("path", F.translate("rel_path", "\\", "/"))


def readme_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First heading of every readme that begins with its first chunk."""
    c = one_per_key(table(spark, sf_dir, "chunks").select("id", "project_id", "rel_path", "line_start", "content"), "id")
    c = c.where("line_start = 1").where(F.lower(F.translate("rel_path", "\\", "/")).rlike(r"(?:^|/)readme\.[a-z]+$"))
    return c.select("id", "project_id", F.regexp_extract("content", r"(?m)^#{1,6}[ \t]+([^\r\n]+)", 1).alias("title")).where("title <> ''")


def project_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files of each project as one sorted list."""
    f = _files(spark, sf_dir).where(F.lower(F.element_at(F.split("path", "/"), -1)).isin(CONFIGS))
    return f.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("path")), "; ").alias("configs"))


def project_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short text report per project."""
    f = _files(spark, sf_dir).groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n_files"), F.count_if(F.col("indexed") == 1).alias("n_indexed"), F.sum("size").alias("bytes"))
    p = table(spark, sf_dir, "projects").select("id", "name", T.json_strings(F.col("technologies")).alias("tech"))
    j = p.join(f, "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    card = F.concat(F.lit("# "), "name", F.lit("\n\n- files: "), n("n_files"), F.lit(" ("), n("n_indexed"), F.lit(" indexed, "), n("bytes"), F.lit(" bytes)\n- technologies: "), F.array_join(F.array_sort("tech"), ", "), F.lit("\n"))
    return j.select("id", card.alias("card"))


def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of an audit: severity P0 (leaks), P1 (gaps), P2 (oddities), code, id of the file or chunk."""
    f = _files(spark, sf_dir)
    c = table(spark, sf_dir, "chunks").select(F.col("id").alias("chunk_id"), F.col("file_id").alias("id")).distinct()
    held = c.select("id").distinct()
    find = lambda df, sev, code, key="id": df.select(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.col(key).alias("item"))
    kind = P.classify(F.col("rel_path"), F.col("size"))
    parts = [
        find(f.where((F.col("indexed") == 1) & (kind == "sensitive")), "P0", "sensitive_file_indexed"),
        find(f.where("indexed = 1").join(held, "id", "left_anti"), "P1", "indexed_file_without_chunks"),
        find(c.join(f, "id", "left_anti"), "P1", "chunk_without_file", "chunk_id"),
        find(f.where("indexed = 0 AND skipped_reason IS NULL"), "P2", "skipped_without_reason"),
        find(f.where((F.col("indexed") == 1) & (F.col("size") > P.MAX_BYTES)), "P2", "large_file_indexed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def severity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


def import_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks taken apart into bodies and occurrences and put together again: rows of each, and rows that differ (0)."""
    c = one_per_key(table(spark, sf_dir, "chunks").select("id", "file_id", "line_start", "line_end", "content"), "id").withColumn("digest", F.sha2("content", 256))
    bodies = c.groupBy("digest").agg(F.min("content").alias("content"))
    again = c.select("id", "file_id", "line_start", "line_end", "digest").join(bodies, "digest").select("id", "file_id", "line_start", "line_end", F.sha2("content", 256).alias("digest"))
    counts = {"chunks": c, "bodies": bodies, "occurrences": again, "differences": V.same_rows(c.select("id", "file_id", "line_start", "line_end", "digest"), again)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in counts.items()])


def han_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han characters and pairs of neighbours as terms, with the number of documents that hold them."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.col("text").rlike(r"\p{IsHan}"))
    one = F.transform(F.regexp_extract_all("text", F.lit(r"\p{IsHan}"), 0), lambda x: F.concat(F.lit("c:"), x))
    two = F.transform(F.regexp_extract_all("text", F.lit(r"(?=(\p{IsHan}{2}))"), 1), lambda x: F.concat(F.lit("b:"), x))
    return d.select("doc_id", F.explode(F.array_distinct(F.concat(one, two))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def identifier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of identifiers (cut at underscores and humps) with the number of chunks that hold them."""
    c = one_per_key(spread(table(spark, sf_dir, "chunks").select("id", "content"), "id"), "id")
    words = F.regexp_extract_all("content", F.lit(r"[A-Za-z][A-Za-z0-9_]*"), 0)
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace(F.array_join(words, " "), "_+", " "), r"([a-z0-9])([A-Z])", "$1 $2")), " +")
    return c.select("id", F.explode(F.array_distinct(parts)).alias("part")).where("part <> ''").groupBy("part").agg(F.count("*").alias("n_chunks"))


def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest change of each project, for the choice between a full and a quick refresh."""
    return _files(spark, sf_dir).groupBy("project_id").agg(F.max(F.struct("mtime", "id")).alias("x")).select("project_id", F.col("x.id").alias("id"), F.floor("x.mtime").alias("second"))


QUERIES = {f.__name__: f for f in (readme_titles, project_configs, project_cards, audit_findings, severity_tally, import_proof, han_terms, identifier_parts, newest_files)}

from strataseek.plans.catalogue import _PATH  # noqa: E402

_F = "f AS (SELECT DISTINCT id, project_id, rel_path, size, indexed, skipped_reason, mtime, replace(rel_path, '\\', '/') AS path FROM files)"
_FIND = f"""WITH {_F}, c AS (SELECT DISTINCT id AS chunk_id, file_id FROM chunks), findings AS (
SELECT 'P0' AS severity, 'sensitive_file_indexed' AS code, id AS item FROM f WHERE indexed = 1 AND (regexp_matches({_PATH}, 'secret|credential|private_key|apikey|api_key|access_token|refresh_token') OR regexp_matches({_PATH}, '(^|/)([.]env([.][a-z]+)?|[.]npmrc|[.]pypirc|id_rsa|id_dsa|id_ecdsa|id_ed25519|auth[.]json|token[.]json)$|[.](pem|key|p12|pfx|crt)$'))
UNION ALL SELECT 'P1', 'indexed_file_without_chunks', id FROM f WHERE indexed = 1 AND id NOT IN (SELECT file_id FROM c WHERE file_id IS NOT NULL)
UNION ALL SELECT 'P1', 'chunk_without_file', chunk_id FROM c WHERE file_id NOT IN (SELECT id FROM f)
UNION ALL SELECT 'P2', 'skipped_without_reason', id FROM f WHERE indexed = 0 AND skipped_reason IS NULL
UNION ALL SELECT 'P2', 'large_file_indexed', id FROM f WHERE indexed = 1 AND size > 700000)
"""

ORACLES = {
    "readme_titles": f"SELECT * FROM (SELECT DISTINCT id, project_id, regexp_extract(content, '(?m)^#{{1,6}}[ \\t]+([^\\r\\n]+)', 1) AS title FROM chunks WHERE line_start = 1 AND regexp_matches({_PATH}, '(?:^|/)readme\\.[a-z]+$')) WHERE title <> ''",
    "project_configs": f"WITH {_F} SELECT project_id, string_agg(DISTINCT path, '; ' ORDER BY path) AS configs FROM f WHERE regexp_extract(lower(path), '[^/]*$') IN ('package.json', 'pyproject.toml', 'vite.config.ts') GROUP BY ALL",
    "project_cards": f"""WITH {_F}, n AS (SELECT project_id, count(*) AS a, count(*) FILTER (indexed = 1) AS b, sum(size)::BIGINT AS s FROM f GROUP BY ALL)
SELECT id, '# ' || name || chr(10) || chr(10) || '- files: ' || coalesce(a, 0) || ' (' || coalesce(b, 0) || ' indexed, ' || coalesce(s, 0) || ' bytes)' || chr(10) || '- technologies: ' || coalesce(array_to_string(list_sort(CASE WHEN json_valid(technologies) THEN technologies::JSON::VARCHAR[] END), ', '), '') || chr(10) AS card FROM projects LEFT JOIN n ON id = project_id""",
    "audit_findings": _FIND + "SELECT * FROM findings",
    "severity_tally": _FIND + "SELECT severity, count(*) AS n FROM findings GROUP BY ALL",
    "import_proof": "SELECT 'chunks' AS relation, count(DISTINCT id) AS n FROM chunks UNION ALL SELECT 'bodies', count(DISTINCT content) FROM chunks UNION ALL SELECT 'occurrences', count(DISTINCT id) FROM chunks WHERE content IS NOT NULL UNION ALL SELECT 'differences', 0",
    "han_terms": """WITH d AS (SELECT doc_id, text, unnest(range(1, length(text)::BIGINT + 1)) AS i FROM documents WHERE regexp_matches(text, '\\p{Han}')),
t AS (SELECT DISTINCT doc_id, 'c:' || substr(text, i, 1) AS term FROM d WHERE regexp_full_match(substr(text, i, 1), '\\p{Han}') UNION SELECT DISTINCT doc_id, 'b:' || substr(text, i, 2) FROM d WHERE regexp_full_match(substr(text, i, 2), '\\p{Han}{2}'))
SELECT term, count(*) AS df FROM t GROUP BY ALL""",
    "identifier_parts": """WITH c AS (SELECT DISTINCT id, content FROM chunks), w AS (SELECT id, unnest(list_distinct(regexp_split_to_array(lower(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9_]*'), ' '), '_+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' +'))) AS part FROM c)
SELECT part, count(*) AS n_chunks FROM w WHERE part <> '' GROUP BY ALL""",
    "newest_files": f"WITH {_F} SELECT project_id, arg_max(id, (mtime, id)) AS id, floor(max(mtime))::BIGINT AS second FROM f GROUP BY ALL",
}
