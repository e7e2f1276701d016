"""Queries on texts, paths and project features, composite answers, and plain relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek.functions import paths as P
from strataseek.functions import text as T
from strataseek.operators import chunking as C
from strataseek.operators import fulltext as X
from strataseek.operators import graph as G
from strataseek.operators import ranking as R
from strataseek.operators import versioning as V
from strataseek.operators.dedup import one_per_key
from strataseek.plans.search import search_table, stored_index
from strataseek.plans.versions import _edges
from strataseek.runtime import materialise, spread, table


def slugify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", T.slugify(F.col("rel_path")).alias("slug"), T.path_key(F.col("rel_path")).alias("path_key")).distinct()


def compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.compact_line(F.col("text"), 80).alias("line"))


def claim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = one_per_key(table(spark, sf_dir, "summaries").select("id", "content"), "id")
    return s.select("id", F.posexplode(T.claims(F.col("content"))).alias("ordinal", "claim"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("id", T.line_count(F.col("content")).alias("n_lines")).distinct()


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "files").select("id", P.classify(F.col("rel_path"), F.col("size")).alias("kind")).distinct()
    return f.select("id", "kind", P.skip_reason(F.col("kind")).alias("reason"))


def path_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").select("id", P.triage(F.col("rel_path")).alias("risk")).where("risk IS NOT NULL").distinct()


def high_value_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = one_per_key(table(spark, sf_dir, "files").select("id", "project_id", "rel_path", "indexed"), "id")
    return f.groupBy("project_id").agg(F.count_if(P.high_value(F.col("rel_path"))).alias("n_high_value"), F.count_if(P.high_value(F.col("rel_path")) & (F.col("indexed") == 1)).alias("n_indexed"))


def priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty best chunks: by score, then those of priority files first."""
    hits = search_table(spark, sf_dir, "chunks", "id", "content", "snapshot claim")
    kinds = one_per_key(table(spark, sf_dir, "chunks").select("id", "kind"), "id")
    j = hits.join(kinds, "id").withColumn("behind", F.when(F.col("kind") == "priority", 0).otherwise(1))
    return R.page(j, ["score", "behind", "id"], 50).select("id", "kind", "score")


def like_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search in notes: matches of the type or target before matches of the text only, newest first."""
    n = one_per_key(table(spark, sf_dir, "summaries").select("id", "target_id", "summary_type", "content"), "id")
    has = lambda c: F.lower(c).contains("parser")
    place = F.when(has("target_id"), 0).when(has("summary_type"), 1).otherwise(2)
    n = n.where(has("target_id") | has("summary_type") | has("content")).select("id", place.alias("place"), (-F.col("id")).alias("newest"))
    return R.page(n, ["place", "newest"], 40).select("id", "place")


def bracket_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 words around the first hit, hits in brackets."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.bracketed(F.col("text"), ["evidence", "claim"]).alias("snippet"))
    return d.where("snippet IS NOT NULL")


def secret_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the index must refuse."""
    return table(spark, sf_dir, "chunks").where(F.col("content").rlike(P.SECRET_TEXT)).select("id").distinct()


def lossless_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_table(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", lossless=False)


def lossless_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document put together again from its chunks: digest of the result, and whether all chunks keep the limits and follow each other."""
    c = lossless_chunks(spark, sf_dir)
    one = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content", "line_start", "line_end"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["content"]), "")
    kept = F.forall("c", lambda x: (F.length(x["content"]) <= C.MAX_CHARS) & (x["line_end"] - x["line_start"] < C.MAX_LINES)) & (F.transform("c", lambda x: x["ordinal"]) == F.sequence(F.lit(0).cast("long"), F.size("c").cast("long") - 1))
    return one.select("doc_id", F.sha2(text, 256).alias("digest"), kept.alias("within_limits"), (F.element_at("c", -1)["line_end"]).cast("long").alias("n_lines"))


def chunk_lines_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the line chunks of every document hold beside white space."""
    c = chunk_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("c"))
    text = F.regexp_replace(F.array_join(F.transform("c", lambda x: x["content"]), ""), r"(?U)\s+", "")
    return c.select("doc_id", F.sha2(text, 256).alias("digest"))


def readme_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best readme of each project: nearest to the root, by extension, then by path."""
    f = one_per_key(table(spark, sf_dir, "files").select("id", "project_id", "rel_path"), "id").withColumn("p", F.translate("rel_path", "\\", "/"))
    f = f.where(F.lower("p").rlike(r"(?:^|/)readme\.(?:md|mdx|rst|txt)$"))
    depth, ext = F.size(F.split("p", "/")), F.array_position(F.array(*map(F.lit, ("md", "mdx", "rst", "txt"))), P.extension(F.col("p")))
    return V.latest_per_key(f, ["project_id"], depth, ext, F.col("p"), F.col("id"), smallest=True).select("project_id", "id", F.col("p").alias("readme_path"))


#: Keywords of a few domains; a parameter in spirit.
DOMAINS = {"search": ["index", "query", "rank"], "storage": ["snapshot", "lock", "cache"], "review": ["audit", "claim", "citation"]}


def domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of each project: distinct keywords its documents hold, three or more counted."""
    words = spark.createDataFrame([(d, w) for d, ws in DOMAINS.items() for w in ws], "domain string, word string")
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("word"))
    hit = d.join(F.broadcast(words), "word").groupBy("source", "domain").agg(F.countDistinct("word").alias("n_words"), F.count("*").alias("n_hits"))
    return hit.where("n_words >= 3")


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technologies of each project by the extensions of its files."""
    f = one_per_key(table(spark, sf_dir, "files").select("id", "project_id", "rel_path"), "id")
    tech = F.create_map(*(F.lit(x) for kv in {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "sql": "sql", "sh": "shell"}.items() for x in kv))
    t = f.select("project_id", F.try_element_at(tech, P.extension(F.col("rel_path"))).alias("technology")).where("technology IS NOT NULL")
    return t.groupBy("project_id", "technology").agg(F.count("*").alias("n_files"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts").where("description IS NOT NULL").select(F.col("id").alias("concept_id"), F.posexplode(T.claims(F.col("description"))).alias("ordinal", "claim"))
    return c.withColumn("terms", F.slice(F.array_distinct(F.filter(T.terms(F.col("claim")), lambda t: (F.length(t) > 1) & ~t.isin(*sorted(R.STOP_WORDS)))), 1, R.MAX_TERMS))


#: Terms of claims that are broadcast; more take a shuffled join.
CLAIM_TERMS_MAX = 100_000


def audit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim of the concept descriptions with its five best chunks: supported_candidate or needs_evidence.

    All claims are ranked in one pass over the postings of their terms, a
    fixed set that is counted before it is broadcast.
    """
    claims = materialise(_claims(spark, sf_dir))
    index, stats = stored_index(spark, sf_dir, "chunks", "id", "content")
    asked = materialise(claims.select("concept_id", "ordinal", F.explode("terms").alias("term")).withColumn("bucket", X.bucket(F.col("term"))))
    few = asked.limit(CLAIM_TERMS_MAX + 1).count() <= CLAIM_TERMS_MAX
    side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    tf = materialise(index.join(side(asked.select("bucket", "term").distinct()), ["bucket", "term"]).select(F.col("doc").cast("long").alias("id"), "term", "tf", "dl"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    size = stats.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t")).first()
    n, mean = F.lit(float(size.n)), F.lit(float(size.t or 0) / float(size.n or 1))
    one = tf.join(side(df), "term")
    idf = F.greatest(F.lit(R.IDF_FLOOR), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = one.select("id", "term", (idf * F.col("tf") * (R.K1 + 1) / (F.col("tf") + R.K1 * (1 - R.B + R.B * F.col("dl") / mean))).alias("part"))
    scored = part.join(side(asked), "term").groupBy("concept_id", "ordinal", "id").agg(F.round(-F.sum("part"), 6).alias("score"))
    top = scored.withColumn("rank", F.row_number().over(Window.partitionBy("concept_id", "ordinal").orderBy("score", "id"))).where("rank <= 5")
    j = claims.select("concept_id", "ordinal", F.size("terms").alias("n_terms")).join(top, ["concept_id", "ordinal"], "left")
    status = F.when(F.col("n_terms") == 0, "needs_narrower_query").when(F.col("id").isNull(), "needs_evidence").otherwise("supported_candidate")
    return j.select("concept_id", "ordinal", "rank", F.col("id").alias("chunk_id"), "score", status.alias("status"))


def resume_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten projects that fit a role best, each with its six best documents."""
    words = ["python", "search", "index", "parser", "query"]
    p = table(spark, sf_dir, "projects")
    text = F.lower(F.concat_ws(" ", "name", "technologies", "domains", "readme_path"))
    fit = p.select(F.col("id").alias("source"), sum((text.contains(w).cast("int") for w in words[1:]), text.contains(words[0]).cast("int")).alias("fit"))
    top = fit.orderBy(F.desc("fit"), "source").limit(10)
    hits = search_table(spark, sf_dir, "documents", "doc_id", "text", " ".join(words))
    mine = table(spark, sf_dir, "documents").select("doc_id", "source").join(hits, "doc_id").join(F.broadcast(top), "source")
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("score", "doc_id"))).where("rank <= 6").select("source", "fit", "rank", "doc_id", "score")


def hybrid_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the projects of the eight best hits, eight each."""
    hits = R.page(search_table(spark, sf_dir, "documents", "doc_id", "text", "lexical index"), ["score", "doc_id"], 8)
    near = table(spark, sf_dir, "documents").select("doc_id", "source").join(F.broadcast(hits), "doc_id").where("source IS NOT NULL").select(F.col("source").alias("source_id")).distinct()
    return G.top_edges(_edges(spark, sf_dir), 8).join(F.broadcast(near), "source_id")


def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left_anti").select("c_custkey", "c_name")


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return V.latest_per_key(e, ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("qty"), "l_partkey")
    return line.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each chunk in its file, from the running length of those before it."""
    c = one_per_key(table(spark, sf_dir, "chunks").select("id", "file_id", "line_start", F.length("content").alias("n")), "id")
    w = Window.partitionBy("file_id").orderBy("line_start", "id").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("id", "file_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("char_start"))


def union_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    both = e.where("event_type = 'click'").select("user_id").unionAll(e.where("event_type = 'purchase'").select("user_id"))
    return both.groupBy("user_id").agg(F.count("*").alias("n"))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with half an hour between them."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        high_value_files, priority_sort, like_order, bracket_snippets, slugify_paths, compact_lines, claim_split, line_counts, classify_files, path_triage, secret_filter, lossless_chunks, chunk_lines, lossless_round_trip, chunk_lines_text, readme_choice, domain_keywords, technologies, audit_claims, resume_pack, hybrid_related,
        join_inner, join_left, join_semi, join_anti, latest_per_key, topk_per_group, running_offsets, union_hits, session_counts,
    )
}

from strataseek.plans.search import _T as _TOKENS  # noqa: E402
from strataseek.plans.search import _score  # noqa: E402
from strataseek.plans.versions import _EDGES, _KEY  # noqa: E402

_PATH = r"lower(replace(rel_path, '\', '/'))"
_NAME = f"regexp_extract({_PATH}, '[^/]*$')"
_STEM = f"regexp_replace({_NAME}, '\\.[a-z0-9]+$', '')"
_EXT = "lower(regexp_extract(rel_path, '\\.([A-Za-z0-9]+)$', 1))"
_sql_list = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_STOP = _sql_list(sorted(R.STOP_WORDS))
_Q = ["python", "search", "index", "parser", "query"]
_CLAIMS = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([^0-9])\\.|\\.([^0-9]|$)', '\\1' || chr(1) || '\\2', 'g'), '[!?;。！？；\\r\\n\x01]+'), lambda x: trim(x)), lambda x: x <> '')"

ORACLES = {
    "slugify_paths": rf"""SELECT DISTINCT id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, {_KEY} AS path_key FROM (SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(replace(trim(rel_path), '\', '/'), '^.*/', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g')) AS s FROM files)""",
    "compact_lines": r"SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE regexp_replace(substr(f, 1, 79), '\s+$', '') || '…' END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)",
    "claim_split": f"WITH s AS (SELECT DISTINCT id, content FROM summaries), l AS (SELECT id, {_CLAIMS.format('content')} AS c FROM s) SELECT id, (generate_subscripts(c, 1) - 1)::INT AS ordinal, unnest(c) AS claim FROM l",
    "line_counts": r"SELECT DISTINCT id, (length(x) - length(replace(x, chr(10), '')) + CASE WHEN x LIKE '%' || chr(10) THEN 0 ELSE 1 END)::INT AS n_lines FROM (SELECT id, regexp_replace(content, '\r\n|\r', chr(10), 'g') AS x FROM chunks)",
    "high_value_files": r"""WITH f AS (SELECT DISTINCT id, project_id, indexed, lower(replace(rel_path, '\', '/')) AS p FROM files), h AS (SELECT *, starts_with(split_part(p, '/', -1), 'readme') OR split_part(p, '/', -1) IN ('agents.md', 'pyproject.toml', 'package.json', 'requirements.txt', 'environment.yml', 'setup.py', 'dockerfile', 'docker-compose.yml', 'makefile', 'tsconfig.json')
  OR split_part(p, '/', 1) IN ('docs', 'doc', 'tests', 'test', 'submission') AND contains(p, '/') OR contains(p, 'report') OR contains(p, 'result') OR contains(p, 'metric') OR contains(p, 'benchmark') OR contains(p, 'eval') AS hv FROM f)
SELECT project_id, count(*) FILTER (hv) AS n_high_value, count(*) FILTER (hv AND indexed = 1) AS n_indexed FROM h GROUP BY ALL""",
    "priority_sort": f"""WITH c AS (SELECT DISTINCT id, kind, content FROM chunks), {_score('c', 'id', 'content', ['snapshot', 'claim'])} SELECT id, kind, score FROM ranked ORDER BY score, CASE WHEN kind = 'priority' THEN 0 ELSE 1 END, id LIMIT 50""",
    "like_order": """WITH n AS (SELECT id, max_by(target_id, (target_id, summary_type, content)) AS target_id, max_by(summary_type, (target_id, summary_type, content)) AS summary_type, max_by(content, (target_id, summary_type, content)) AS content FROM summaries GROUP BY id)
SELECT id, CASE WHEN target_id ILIKE '%parser%' THEN 0 WHEN summary_type ILIKE '%parser%' THEN 1 ELSE 2 END AS place FROM n WHERE target_id ILIKE '%parser%' OR summary_type ILIKE '%parser%' OR content ILIKE '%parser%' ORDER BY place, id DESC LIMIT 40""",
    "bracket_snippets": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS ws FROM documents), f AS (SELECT doc_id, ws, list_position(list_transform(ws, lambda x: lower(x) IN ('evidence', 'claim')), true) AS first FROM w),
s AS (SELECT doc_id, ws, greatest(first - 8, 1) AS start FROM f WHERE first > 0)
SELECT doc_id, CASE WHEN start > 1 THEN '... ' ELSE '' END || array_to_string(list_transform(ws[start:start + 23], lambda x: CASE WHEN lower(x) IN ('evidence', 'claim') THEN '[' || x || ']' ELSE x END), ' ') || CASE WHEN start + 23 < len(ws) THEN ' ...' ELSE '' END AS snippet FROM s""",
    # spelled out with values of its own, so that a wrong pattern of the engine shows
    "classify_files": r"""WITH f AS (SELECT DISTINCT id, size, lower(replace(rel_path, '\', '/')) AS p FROM files), n AS (SELECT *, split_part(p, '/', -1) AS name, split_part(split_part(p, '/', -1), '.', -1) AS ext, contains(split_part(p, '/', -1), '.') AS dotted FROM f),
k AS (SELECT id, CASE
  WHEN contains(p, 'secret') OR contains(p, 'credential') OR contains(p, 'private_key') OR contains(p, 'apikey') OR contains(p, 'api_key') OR contains(p, 'access_token') OR contains(p, 'refresh_token')
    OR name IN ('.env', '.env.local', '.env.development', '.env.production', '.npmrc', '.pypirc', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', 'auth.json', 'token.json') OR (dotted AND ext IN ('pem', 'key', 'p12', 'pfx', 'crt')) THEN 'sensitive'
  WHEN name IN ('package-lock.json', 'pnpm-lock.yaml') OR (dotted AND ext = 'lock') OR contains('/' || p, '/__pycache__/') OR contains('/' || p, '/node_modules/') OR contains('/' || p, '/.git/') OR contains('/' || p, '/dist/') OR contains('/' || p, '/build/') THEN 'low_value'
  WHEN size > 700000 THEN 'large'
  WHEN name IN ('package.json', 'pyproject.toml', 'requirements.txt', 'setup.py', 'setup.cfg', 'vite.config.ts', 'vite.config.js', 'tsconfig.json', 'dockerfile', 'makefile') OR (dotted AND left(name, -length(ext) - 1) IN ('readme', 'agents', 'architecture', 'design_notes', 'project_summary', 'data_card', 'model_card') AND ext IN ('md', 'mdx', 'txt', 'rst', 'tex', 'html', 'css', 'py', 'ipynb', 'js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs', 'json', 'jsonl', 'toml', 'yaml', 'yml', 'ini', 'cfg', 'csv', 'tsv', 'sql', 'sh', 'go', 'rs', 'java', 'c', 'h', 'cpp')) THEN 'priority'
  WHEN dotted AND ext IN ('md', 'mdx', 'txt', 'rst', 'tex', 'html', 'css', 'py', 'ipynb', 'js', 'jsx', 'ts', 'tsx', 'mjs', 'cjs', 'json', 'jsonl', 'toml', 'yaml', 'yml', 'ini', 'cfg', 'csv', 'tsv', 'sql', 'sh', 'go', 'rs', 'java', 'c', 'h', 'cpp') THEN 'source' ELSE 'unsupported' END AS kind FROM n)
SELECT id, kind, CASE kind WHEN 'sensitive' THEN 'sensitive_path' WHEN 'low_value' THEN 'policy_excluded' WHEN 'large' THEN 'file_too_large' WHEN 'unsupported' THEN 'unsupported_type' END AS reason FROM k""",
    "path_triage": r"""WITH f AS (SELECT DISTINCT id, lower(replace(rel_path, '\', '/')) AS p FROM files), n AS (SELECT *, split_part(p, '/', -1) AS name FROM f)
SELECT * FROM (SELECT id, CASE WHEN name IN ('id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519') OR ends_with(name, '.pem') OR ends_with(name, '.key') OR ends_with(name, '.p12') OR ends_with(name, '.pfx') OR ends_with(name, '.crt') OR contains(p, 'private_key') THEN 'key'
  WHEN name IN ('.env', '.env.local', '.env.development', '.env.production', '.npmrc', '.pypirc') THEN 'environment' WHEN contains(p, 'secret') OR contains(p, 'credential') OR name = 'auth.json' THEN 'credential'
  WHEN contains(p, 'access_token') OR contains(p, 'refresh_token') OR contains(p, 'api_key') OR contains(p, 'apikey') OR name = 'token.json' THEN 'token' END AS risk FROM n) WHERE risk IS NOT NULL""",
    "lossless_round_trip": r"""SELECT doc_id, sha256(text) AS digest, true AS within_limits, length(x) - length(replace(x, chr(10), '')) + CASE WHEN x LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n_lines
  FROM (SELECT doc_id, text, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS x FROM documents) WHERE text <> ''""",
    "chunk_lines_text": r"SELECT doc_id, sha256(b) AS digest FROM (SELECT doc_id, regexp_replace(text, '[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}\x{0085}]+', '', 'g') AS b FROM documents) WHERE b <> ''",
    "secret_filter": "SELECT DISTINCT id FROM chunks WHERE regexp_matches(content, '" + P.SECRET_TEXT.replace("'", "''") + "')",
    "readme_choice": f"""SELECT project_id, id, replace(rel_path, '\\', '/') AS readme_path FROM (SELECT DISTINCT id, project_id, rel_path FROM files) WHERE regexp_matches({_PATH}, '(?:^|/)readme\\.(?:md|mdx|rst|txt)$')
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY len(string_split(replace(rel_path, '\\', '/'), '/')), list_position(['md', 'mdx', 'rst', 'txt'], {_EXT}), replace(rel_path, '\\', '/'), id) = 1""",
    "domain_keywords": f"""WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{w}')" for d, ws in DOMAINS.items() for w in ws)}) v(domain, word)), d AS (SELECT source, unnest(list_distinct({_TOKENS.format('text')})) AS word FROM documents WHERE source IS NOT NULL)
SELECT source, domain, count(DISTINCT word) AS n_words, count(*) AS n_hits FROM d JOIN w USING (word) GROUP BY ALL HAVING count(DISTINCT word) >= 3""",
    "technologies": f"""WITH f AS (SELECT DISTINCT id, project_id, rel_path FROM files), t AS (SELECT project_id, CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'sql' THEN 'sql' WHEN 'sh' THEN 'shell' END AS technology FROM f)
SELECT project_id, technology, count(*) AS n_files FROM t WHERE technology IS NOT NULL GROUP BY ALL""",
    "audit_claims": f"""WITH l AS (SELECT id AS concept_id, {_CLAIMS.format('description')} AS c FROM concepts WHERE description IS NOT NULL), cl AS (SELECT concept_id, (generate_subscripts(c, 1) - 1)::INT AS ordinal, unnest(c) AS claim FROM l),
ct AS (SELECT concept_id, ordinal, list_filter({_TOKENS.format('claim')}, lambda t: length(t) > 1 AND t NOT IN {_STOP}) AS ts FROM cl), cd AS (SELECT concept_id, ordinal, list_filter(ts, lambda t, i: list_position(ts, t) = i)[1:12] AS ts FROM ct),
asked AS (SELECT concept_id, ordinal, unnest(ts) AS term FROM cd), k AS (SELECT DISTINCT id, {_TOKENS.format('content')} AS t FROM chunks), st AS (SELECT count(*) AS n, avg(len(t)) AS av FROM k),
tf AS (SELECT id, len(t)::DOUBLE AS dl, unnest(t) AS term FROM k), f AS (SELECT id, dl, term, count(*)::DOUBLE AS tf FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
s AS (SELECT concept_id, ordinal, id, round(-sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM asked JOIN f USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY concept_id, ordinal ORDER BY score, id)::INT AS rank FROM s QUALIFY rank <= 5)
SELECT concept_id, ordinal, rank, id AS chunk_id, score, CASE WHEN len(ts) = 0 THEN 'needs_narrower_query' WHEN id IS NULL THEN 'needs_evidence' ELSE 'supported_candidate' END AS status FROM cd LEFT JOIN r USING (concept_id, ordinal)""",
    "resume_pack": f"""WITH p AS (SELECT id AS source, ({' + '.join(f"contains(lower(concat_ws(' ', name, technologies, domains, readme_path)), '{w}')::INT" for w in _Q)})::INT AS fit FROM projects ORDER BY fit DESC, source LIMIT 10), {_score('documents', 'doc_id', 'text', _Q)}
SELECT source, fit, row_number() OVER (PARTITION BY source ORDER BY score, doc_id)::INT AS rank, doc_id, score FROM ranked JOIN p USING (source) QUALIFY rank <= 6""",
    "hybrid_related": f"""WITH {_EDGES}, {_score('documents', 'doc_id', 'text', ['lexical', 'index'])}, h AS (SELECT * FROM ranked ORDER BY score, doc_id LIMIT 8),
t AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, relation_type, target_id) <= 8) SELECT * FROM t WHERE source_id IN (SELECT source FROM h)""",
    "join_inner": "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
    "join_semi": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY ALL",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "topk_per_group": "SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty DESC, l_partkey)::INT AS rank FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) QUALIFY rank <= 3",
    "running_offsets": "WITH c AS (SELECT DISTINCT id, file_id, line_start, length(content) AS n FROM chunks) SELECT id, file_id, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY line_start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM c",
    "union_hits": "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY ALL",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS start FROM events), s AS (SELECT user_id, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY ALL""",
}
