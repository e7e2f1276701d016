"""The public interface: one method per entry point, each giving a plain dict.

Plans are lazy DataFrames up to the last step; only pages, single records and
counts reach the driver.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataseek import cursors
from strataseek.errors import GenerationConflict, NotFound
from strataseek.functions import text as T
from strataseek.operators import fulltext as X
from strataseek.operators import graph as G
from strataseek.operators import ranking as R
from strataseek.operators import versioning as V
from strataseek.runtime import deadline, materialise
from strataseek.sources import files
from strataseek.sources import projects as P
from strataseek.store import SCHEMAS, Store, Transaction
from strataseek.streaming.ingest import append_evidence, append_texts, index_texts

#: Fields of a compact result.
COMPACT = ["kind", "id", "project_id", "rel_path", "score", "snippet", "snippet_start", "line_start", "line_end", "version_id", "availability"]
MODES = ("fts", "hybrid", "graph", "vector")
_SUMMARY = ["summary_id", "target_type", "target_id", "summary_type", "evidence_ids", "record_type", "summary_family", "supersedes_id", "content_status", "provenance_review", "created_seq"]


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _bounded(value, low: int, high: int, name: str) -> int:
    _check(type(value) is int and low <= value <= high, f"{name} must be from {low} to {high}")
    return value


_slug = T.slug_text


def _bounded_read(f):
    """Ends a read after ``KnowledgeBase.read_seconds``."""

    @wraps(f)
    def read(self, *args, **kwargs):
        with deadline(self.spark, self.read_seconds):
            return f(self, *args, **kwargs)

    return read


class KnowledgeBase:
    #: Seconds a read may take.
    read_seconds = 60.0

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # -- set-up and writes

    def init(self) -> dict:
        return self.store.init()

    def register_root(self, operation_id: str, project_id: str, root: str, name: str | None = None) -> dict:
        """Register a project and its folder; always a new generation."""
        _check(bool(project_id) and bool(root), "project_id and root are required")
        request = {"project_id": project_id, "root": root, "name": name}
        row = [(project_id, name or project_id, root)]
        return self.store.execute("register_root", operation_id, request, lambda t: t.append("projects", self.spark.createDataFrame(row, SCHEMAS["projects"])) and {"status": "registered", "project_id": project_id})

    def register_all(self, operation_id: str, root: str, overrides: dict[str, str] | None = None) -> dict:
        """Register every project below a folder, in one operation; those that are registered with the same folder stay as they are."""
        found = P.discover(root, overrides)

        def handler(txn: Transaction) -> dict:
            known = {r.project_id: r.root for r in self.store.read("projects").select("project_id", "root").collect()}  # a registry, a row per project
            rows = [(x["project_id"], x["name"], x["path"]) for x in found if known.get(x["project_id"]) != x["path"]]
            if rows:
                txn.append("projects", self.spark.createDataFrame(rows, SCHEMAS["projects"]))
            return {"status": "registered", "projects": [r[0] for r in rows], "git": {x["project_id"]: x["git_head"] for x in found if x["is_git"]}}

        return self.store.execute("register_all", operation_id, {"root": root, "overrides": overrides or {}}, handler)

    def refresh_all(self, operation_id: str, mode: str = "full") -> dict:
        """Refresh every registered project, each as an operation of its own, so that a broken run goes on where it stopped."""
        ids = [r.project_id for r in self.store.read("projects").select("project_id").distinct().orderBy("project_id").collect()]
        return {"status": "refreshed", "projects": {i: self.refresh(f"{operation_id}:{i}", i, mode=mode) for i in ids}}

    def _open_memberships(self, seq: int | None = None, history: bool = False) -> DataFrame:
        top = self.store.generation()["seq"] if seq is None else seq
        log = V.close_out(self.store.read("memberships", seq), ["project_id", "path_key"], "valid_from")
        return V.as_of(log, top, history)

    def discover(self, project_id: str, seq: int | None = None, mode: str = "full") -> tuple[DataFrame, DataFrame]:
        """Scanned files of a project, and the actions that bring the store up to date.

        Mode ``full`` reads every file; ``metadata`` takes files of the same
        size and time as known and opens the others only. policy_hidden is a
        file that was indexed and may be no longer.
        """
        _check(mode in ("full", "metadata"), "mode must be full or metadata")
        root = self.store.read("projects", seq).where(F.col("project_id") == project_id).select("root").first()
        if root is None:
            raise NotFound(f"project {project_id} is not registered")
        now = self._open_memberships(seq).where(F.col("project_id") == project_id).join(self.store.read("versions", seq).select("version_id", "sha256", "size", "modified", F.col("reason").alias("old_reason")), "version_id")
        listed = None
        if mode == "metadata":
            now = materialise(now)
            # a listing tells which files are still there as they were; their content is not read
            listed = materialise(files.scan(self.spark, root.root).select(T.path_key(F.col("rel_path")).alias("path_key"), "size", "modified"))
            same = now.where("modified IS NOT NULL").join(listed, ["path_key", "size", "modified"], "left_semi")
        found = files.read(self.spark, root.root, known=None if listed is None else same).withColumn("path_key", T.path_key(F.col("rel_path")))
        cols = lambda df: df.select(F.lit(project_id).alias("project_id"), F.col("path_key").alias("rel_path"), "sha256", "size", "modified")
        there = cols(found) if listed is None else cols(found).unionByName(cols(same))
        actions = V.refresh_diff(cols(now), there).withColumnRenamed("rel_path", "path_key")
        earlier = self.store.read("memberships", seq).where(F.col("project_id") == project_id).select("path_key").distinct().withColumn("before", F.lit(True))
        shown = now.where("old_reason IS NULL").select("path_key", F.lit(True).alias("shown"))
        barred = found.where("reason IS NOT NULL AND reason <> 'read_failed'").select("path_key", F.lit(True).alias("barred"))
        actions = actions.join(earlier, "path_key", "left").join(shown, "path_key", "left").join(barred, "path_key", "left")
        action = F.when((F.col("action") == "new") & F.coalesce("before", F.lit(False)), "restored").when((F.col("action") == "new_version") & F.col("shown") & F.col("barred"), "policy_hidden").otherwise(F.col("action"))
        return found, actions.withColumn("action", action).drop("before", "shown", "barred")

    def refresh(self, operation_id: str, project_id: str, expected_parent: str | None = None, mode: str = "full") -> dict:
        """Bring a project up to date: new versions, renames, tombstones, chunks; one new generation."""

        def handler(txn: Transaction) -> dict:
            parent = self.store.generation()
            if expected_parent is not None and parent["id"] != expected_parent:
                raise GenerationConflict(f"the newest generation is {parent['id']}")
            found, actions = self.discover(project_id, mode=mode)
            fresh = found.join(actions.where("action NOT IN ('unchanged', 'tombstone', 'renamed_away')").select("path_key", "action"), "path_key")
            fresh = fresh.withColumn("version_id", F.sha2(F.concat_ws("\x1f", F.lit(project_id), "path_key", F.coalesce("sha256", F.lit("")), F.col("size").cast("string"), F.lit(str(txn.seq))), 256)).withColumn("project_id", F.lit(project_id))
            versions = txn.append("versions", fresh.select("version_id", "project_id", "rel_path", "sha256", "size", "kind", "reason", "modified", "raw", "text"))
            kept = versions.select("version_id", "rel_path", T.path_key(F.col("rel_path")).alias("path_key")).join(actions, "path_key")
            gone = actions.where("action IN ('tombstone', 'renamed_away')").select(F.lit(project_id).alias("project_id"), "path_key", F.col("path_key").alias("rel_path"), F.lit(None).cast("string").alias("version_id"), "action", F.lit(txn.seq).alias("valid_from"), F.lit(True).alias("tombstone"))
            live = kept.select(F.lit(project_id).alias("project_id"), "path_key", "rel_path", "version_id", "action", F.lit(txn.seq).alias("valid_from"), F.lit(False).alias("tombstone"))
            members = txn.append("memberships", live.unionByName(gone))
            moved = actions.where("action = 'possible_move'")
            if not moved.isEmpty():
                name = lambda c: F.concat_ws(":", F.lit(project_id), c)
                txn.append("relations", moved.select(name(F.col("moved_from")).alias("source_id"), F.lit("file").alias("target_type"), name(F.col("path_key")).alias("target_id"), F.lit("possible_move").alias("relation_type"), F.lit(0.5).alias("weight"), F.lit("candidate").alias("status"), F.lit("unreviewed").alias("provenance_review"), F.lit(txn.seq).alias("created_seq")))
            done = append_evidence(self.store, txn, versions)
            tally = {r.action: r.n for r in members.groupBy("action").agg(F.count("*").alias("n")).collect()}
            return {"status": "refreshed", "project_id": project_id, "actions": tally, "n_evidence": done}

        return self.store.execute("refresh", operation_id, {"project_id": project_id, "expected_parent": expected_parent, **({} if mode == "full" else {"mode": mode})}, handler)

    def ingest_texts(self, operation_id: str, rows: DataFrame, label: str) -> dict:
        """Append texts (project_id, rel_path, text) that do not come from a folder."""
        return self.store.execute("ingest", operation_id, {"label": label}, lambda t: append_texts(self.store, t, rows))

    def save_summary(self, operation_id: str, target_type: str, target_id: str, summary_type: str, content: str, evidence_ids: list[str] = (), record_type: str = "note", family: str | None = None, supersedes_id: int | None = None) -> dict:
        """Append a note; its citations and the note it supersedes must exist."""
        _check(target_type in ("project", "concept", "file", "workflow") and bool(content.strip()), "a target type and content are required")
        cited = [e.strip().lower().removeprefix("kb://evidence/") for e in evidence_ids]
        request = {"target": [target_type, target_id, summary_type], "content": content, "evidence": cited, "record_type": record_type, "family": family, "supersedes": supersedes_id}

        def handler(txn: Transaction) -> dict:
            known = self.store.read("occurrences").where(F.col("evidence_id").isin(cited)).select("evidence_id").distinct().count() if cited else 0
            if known < len(set(cited)):
                raise NotFound("a cited evidence does not exist")
            notes = self.store.read("summaries")
            if supersedes_id is not None and notes.where(F.col("summary_id") == supersedes_id).isEmpty():
                raise NotFound(f"summary {supersedes_id} does not exist")
            new_id = (notes.agg(F.max("summary_id")).first()[0] or 0) + 1
            row = [(new_id, target_type, _slug(target_id), summary_type, content, cited, record_type, family, supersedes_id, "unconfirmed", "unreviewed", txn.seq, datetime.now(timezone.utc).replace(tzinfo=None))]
            note = txn.append("summaries", self.spark.createDataFrame(row, SCHEMAS["summaries"]))
            index_texts(txn, note.select(F.col("summary_id").cast("string").alias("doc"), "content"), 0)
            return {"status": "saved", "summary_id": new_id}

        return self.store.execute("save_summary", operation_id, request, handler)

    def build_relations(self, operation_id: str) -> dict:
        """Edges from projects to the technologies of their files, and between projects that share them."""

        def handler(txn: Transaction) -> dict:
            ext = F.regexp_extract("path_key", r"\.([a-z0-9]+)$", 1)
            tags = self._open_memberships().select("project_id", F.lit("technology").alias("kind"), ext.alias("tag")).where("tag <> ''").distinct()
            names = self.store.read("projects").select("project_id", F.explode(F.split(F.lower("name"), r"[ _-]+")).alias("word")).distinct()
            edges = G.tag_edges(tags).unionByName(G.project_edges(tags, names)).withColumns({"status": F.lit("candidate"), "provenance_review": F.lit("unreviewed"), "created_seq": F.lit(txn.seq)})
            return {"status": "saved", "n_edges": txn.append("relations", edges).count()}

        return self.store.execute("relations", operation_id, {}, handler)

    # -- reads

    def hits(self, query: str, seq: int, project_id: str | None = None, include_history: bool = False) -> DataFrame:
        """All hits with their keys: domain, score, order, id, and what is known of them but their text.

        Read from the stored index, whose statistics cover all documents of a
        domain by then; filters never change a score.
        """
        phrases = R.query_phrases(query)
        index, stats = self.store.read("postings", seq), self.store.read("index_stats", seq)
        found = [X.search(index, stats, phrases, domain) for domain in (0, 1)]
        occ = self.store.read("occurrences", seq).join(found[1], F.col("evidence_id") == F.col("doc"))
        if project_id is not None:
            occ = occ.where(F.col("project_id") == project_id)
        if not include_history:
            tracked = self.store.read("memberships", seq).select("version_id").where("version_id IS NOT NULL").distinct().withColumn("tracked", F.lit(True))
            live = self._open_memberships(seq).select("version_id").distinct().withColumn("live", F.lit(True))
            occ = occ.join(tracked, "version_id", "left").join(live, "version_id", "left").where(F.coalesce("live", F.lit(False)) | F.col("tracked").isNull())
        evidence = occ.select(F.lit(1).alias("domain"), "score", F.lit(0).cast("long").alias("order"), F.col("evidence_id").alias("id"), F.lit("evidence").alias("kind"), "project_id", "rel_path", "line_start", "line_end", "digest", "chars", "version_id")
        notes = V.superseded(self.store.read("summaries", seq).drop("content").withColumnRenamed("summary_id", "id"))
        if not include_history:
            notes = notes.where(~F.col("is_superseded"))
        notes = notes.join(found[0], F.col("id").cast("string") == F.col("doc"))
        if project_id is not None:
            notes = notes.where(F.col("target_id") == _slug(project_id))
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        note = notes.select(F.lit(0).alias("domain"), "score", (-F.col("id")).alias("order"), F.col("id").cast("string").alias("id"), F.lit("summary").alias("kind"), F.col("target_id").alias("project_id"), none("string", "rel_path"), none("long", "line_start"), none("long", "line_end"), none("string", "digest"), none("long", "chars"), none("string", "version_id"))
        return note.unionByName(evidence)

    def _snippets(self, rows: list, phrases: list[list[str]], seq: int) -> dict[tuple, tuple]:
        """(domain, id) -> snippet and its start, of at most a page of hits; only their texts are read."""
        digests = sorted({r.digest for r in rows if r.digest})
        notes = [int(r.id) for r in rows if r.domain == 0]
        bodies = self.store.read("bodies", seq).where(F.col("digest").isin(digests)).select(F.lit(1).alias("domain"), F.concat_ws(":", "digest", "chars").alias("id"), "content")
        texts = self.store.read("summaries", seq).where(F.col("summary_id").isin(notes)).select(F.lit(0).alias("domain"), F.col("summary_id").cast("string").alias("id"), "content")
        parts = [df for df, some in ((bodies, digests), (texts, notes)) if some]
        if not parts:
            return {}
        first = F.greatest(R.first_match(F.col("content"), phrases) - 48, F.lit(1))
        got = reduce(DataFrame.unionByName, parts).select("domain", "id", F.substr("content", first, F.lit(256)).alias("snippet"), (first - 1).alias("start")).collect()
        by = {(r.domain, r.id): (r.snippet, r.start) for r in got}
        return {(r.domain, r.id): by.get((r.domain, r.id if r.domain == 0 else f"{r.digest}:{r.chars}"), (None, None)) for r in rows}

    def _availability(self, rows: list, seq: int) -> dict[str, str]:
        """State of the snapshots behind at most a page of hits, by version: available, asset_unavailable or asset_corrupt."""
        ids = sorted({r.version_id for r in rows if r.version_id})
        if not ids:
            return {}
        v = self.store.read("versions", seq).where(F.col("version_id").isin(ids))
        there = F.coalesce("raw", F.encode("text", "UTF-8"))
        # a text that did not come as bytes has the digest of its text
        state = F.when(there.isNull(), "asset_unavailable").when(F.sha2(there, 256) != F.col("sha256"), "asset_corrupt").otherwise("available")
        return {r.version_id: r.state for r in v.select("version_id", state.alias("state")).collect()}

    @_bounded_read
    def search_page(self, query: str, project_id: str | None = None, generation_id: str | None = None, include_history: bool = False, limit: int = 20, cursor: str | None = None) -> dict:
        """One page of ranked hits, summaries first, with a signed cursor to the next."""
        _check(isinstance(query, str) and 0 < len(query.strip()) <= 256, "query must have 1 to 256 characters")
        _bounded(limit, 1, 100, "limit")
        m = self.store.manifest()
        key = bytes.fromhex(m["cursor_key"])
        scope = {"endpoint": "search", "query": query, "project_id": project_id, "generation_id": generation_id, "history": include_history}
        after = cursors.read(key, scope, cursor) if cursor else None
        gen = self.store.cursor_generation(after[-1]) if after else self.store.generation(generation_id)
        keys = ["domain", "score", "order", "id"]
        rows = self.hits(query, gen["seq"], project_id, include_history)
        got = (R.after_key(rows, keys, after[:-1]) if after else rows).orderBy(*keys).limit(limit + 1).collect()
        cut = self._snippets(got, R.query_phrases(query), gen["seq"])
        states = self._availability(got, gen["seq"])
        items = []
        for r in got:
            snippet, start = cut[(r.domain, r.id)]
            state = "available" if r.domain == 0 else states.get(r.version_id, "asset_unavailable")
            items.append({k: v for k, v in r.asDict().items() if k not in ("digest", "chars")} | {"snippet": snippet, "snippet_start": start, "availability": state})
        base = {"status": "ok" if items else "no_match", "generation": gen["id"]}
        return cursors.pack_page(items, limit, base, lambda x: cursors.sign(key, scope, (*(x[k] for k in keys), gen["id"])), clip="snippet")

    @_bounded_read
    def search(self, query: str, mode: str = "fts", top_k: int = 10, project_id: str | None = None) -> dict:
        """Best hits; ``hybrid`` adds relations of the first hits' projects, ``graph`` gives those only."""
        _check(mode in MODES, f"mode must be one of {MODES}")
        _bounded(top_k, 1, 100, "top_k")
        if mode == "vector":
            return {"status": "unavailable", "reason": "no vector index", "results": []}
        page = self.search_page(query, project_id, limit=top_k)
        out = {"status": page["status"], "generation": page["generation"], "results": [] if mode == "graph" else page["items"]}
        if mode in ("hybrid", "graph"):
            near = list(dict.fromkeys(x["project_id"] for x in page["items"][:8] if x["project_id"]))
            edges = G.top_edges(self.store.read("relations").where(F.col("source_id").isin(near)), 8).collect() if near else []
            out["relations"] = sorted((r.asDict() for r in edges), key=lambda e: (near.index(e["source_id"]), -e["weight"], e["relation_type"], e["target_id"]))
        return out

    @_bounded_read
    def retrieve(self, query: str, project_id: str | None = None, top_k: int = 10) -> dict:
        """Compact results: listed fields only, whole records, within the byte budget."""
        _check(isinstance(query, str) and 0 < len(query.strip()) <= 256, "query must have 1 to 256 characters")
        _check(project_id is None or bool(project_id.strip()), "project_id must not be empty")
        _bounded(top_k, 1, 20, "top_k")
        found = self.search(query, top_k=top_k, project_id=project_id)
        rows = [{k: x.get(k) for k in COMPACT} for x in found["results"]]
        page = cursors.pack_page(rows, len(rows), {"status": found["status"], "generation": found["generation"]}, lambda x: None)
        return {"status": page["status"], "generation": page["generation"], "results": page["items"], "truncated": page["truncated"]}

    @_bounded_read
    def answer(self, question: str, require_evidence: bool = True) -> dict:
        found = self.search(question, "hybrid", 8)
        return {**found, "status": "needs_evidence" if require_evidence and not found["results"] else "ok"}

    @_bounded_read
    def audit_claims(self, text: str) -> dict:
        """Each claim of a text with its best hits."""
        gen = self.store.generation()
        claims = [r.claim for r in self.spark.createDataFrame([(text,)], "t string").select(F.explode(T.claims(F.col("t"))).alias("claim")).collect()]
        best: dict[int, list] = {}
        asked = []
        for i, c in enumerate(claims):
            try:
                R.query_phrases(c)
                asked.append(i)
            except R.QueryError:
                best[i] = None
        # many claims in one job; a request text has few, tables of claims go through plans.catalogue.audit_claims
        for at in range(0, len(asked), 16):
            parts = [self.hits(claims[i], gen["seq"]).orderBy("domain", "score", "order", "id").limit(5).withColumn("claim", F.lit(i)) for i in asked[at : at + 16]]
            for r in reduce(DataFrame.unionByName, parts).collect():
                best.setdefault(r.claim, []).append(r)
        out = []
        for i, c in enumerate(claims):
            rows = best.get(i, [])
            status = "needs_narrower_query" if rows is None else "supported_candidate" if rows else "needs_evidence"
            out.append({"claim": c, "status": status, "results": [r.id for r in sorted(rows or [], key=lambda r: (r.domain, r.score, r.order, r.id))]})
        return {"status": "ok", "claims": out}

    @_bounded_read
    def resume_pack(self, target_role: str, top_projects: int = 10, per_project: int = 6) -> dict:
        """Projects that fit a role, each with its best evidence and newest notes."""
        words = [" ".join(p) for p in R.query_phrases(target_role)]
        gen = self.store.generation()
        hits = self.hits(target_role, gen["seq"]).where("domain = 1")
        w = Window.partitionBy("project_id").orderBy("score", "id")
        fit = self.store.read("projects", gen["seq"]).select("project_id", sum((F.lower("name").contains(x).cast("int") for x in words), F.lit(0)).alias("fit")).dropDuplicates(["project_id"])
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_project).join(fit, "project_id", "left")
        ranked = best.groupBy("project_id").agg(F.max(F.coalesce("fit", F.lit(0))).alias("fit"), F.min("score").alias("best"), F.array_sort(F.collect_list(F.struct("score", "id"))).alias("evidence"))
        rows = ranked.orderBy(F.desc("fit"), "best", "project_id").limit(top_projects).collect()
        notes = self._notes(gen["seq"]).where(F.col("target_id").isin([_slug(r.project_id) for r in rows])) if rows else None
        top = notes.withColumn("rn", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("summary_id")))).where("rn <= 3").collect() if rows else []
        return {"status": "ok" if rows else "needs_evidence", "projects": [{"project_id": r.project_id, "fit": r.fit, "evidence": [e.id for e in r.evidence], "summaries": [n.summary_id for n in top if n.target_id == _slug(r.project_id)]} for r in rows]}

    def _notes(self, seq: int | None = None) -> DataFrame:
        return V.superseded(self.store.read("summaries", seq).withColumnRenamed("summary_id", "id")).withColumnRenamed("id", "summary_id")

    @_bounded_read
    def summary(self, summary_id: int, offset: int = 0, length: int = 4096) -> dict:
        return self._window(self.store.read("summaries").where(F.col("summary_id") == summary_id), _SUMMARY, "content", offset, length)

    @_bounded_read
    def evidence(self, evidence_id: str, offset: int = 0, length: int = 4096, generation_id: str | None = None) -> dict:
        """Characters [offset, offset + length) of a piece of evidence, with what follows."""
        seq = self.store.generation(generation_id)["seq"]
        row = self.store.read("occurrences", seq).where(F.col("evidence_id") == evidence_id).dropDuplicates(["evidence_id"])
        return self._window(row.join(self.store.read("bodies", seq).dropDuplicates(["digest", "chars"]), ["digest", "chars"]), ["evidence_id", "version_id", "project_id", "rel_path", "line_start", "line_end", "char_start", "char_end"], "content", offset, length)

    @_bounded_read
    def file_version(self, version_id: str, field: str = "text", offset: int = 0, length: int = 4096) -> dict:
        _check(field in ("text",), "only text can be read")
        return self._window(self.store.read("versions").where(F.col("version_id") == version_id), ["version_id", "project_id", "rel_path", "sha256", "size", "kind", "reason"], field, offset, length)

    def _window(self, rows: DataFrame, meta: list[str], field: str, offset: int, length: int) -> dict:
        _check(type(offset) is int and offset >= 0, "offset must not be negative")
        _bounded(length, 1, 8192, "length")
        r = rows.select(*meta, T.window(F.col(field), offset, length).alias("content"), F.coalesce(F.length(field), F.lit(0)).alias("total")).first()
        if r is None:
            raise NotFound("the record does not exist")
        _check(offset <= r.total, "offset lies behind the text")
        end = offset + len(r.content or "")
        return {"status": "ok", **{k: r[k] for k in meta}, "content": r.content, "total": r.total, "offset": offset, "next_offset": end if end < r.total else None}

    @_bounded_read
    def summaries(self, target_type: str | None = None, target_id: str | None = None, summary_type: str | None = None, latest_only: bool = False, limit: int = 20, cursor: str | None = None) -> dict:
        """Notes of a target by ascending id, in pages."""
        _bounded(limit, 1, 50, "limit")
        key = bytes.fromhex(self.store.manifest()["cursor_key"])
        scope = {"endpoint": "summaries", "target": [target_type, target_id, summary_type], "latest": latest_only}
        after = cursors.read(key, scope, cursor) if cursor else None
        gen = self.store.cursor_generation(after[-1]) if after else self.store.generation()
        n = self._notes(gen["seq"])
        for col, v in (("target_type", target_type), ("target_id", target_id and _slug(target_id)), ("summary_type", summary_type)):
            n = n.where(F.col(col) == v) if v is not None else n
        if latest_only:
            n = V.latest_per_key(n, ["target_type", "target_id", "summary_type"], F.col("summary_id"))
        n = n.where(F.col("summary_id") > after[0]) if after else n
        rows = [r.asDict() for r in n.orderBy("summary_id").limit(limit + 1).select(*_SUMMARY, "content", "is_current").collect()]
        return cursors.pack_page(rows, limit, {"status": "ok" if rows else "no_match", "generation": gen["id"]}, lambda x: cursors.sign(key, scope, (x["summary_id"], gen["id"])), clip="content")

    @_bounded_read
    def resolve_legacy(self, snapshot_id: str, reference: str) -> dict:
        """Evidence behind an old reference ``path#ordinal`` in a generation."""
        path, _, ordinal = reference.rpartition("#")
        _check(bool(path) and ordinal.isdigit(), "a reference has the form path#ordinal")
        seq = self.store.generation(snapshot_id)["seq"]
        live = self._open_memberships(seq).select("version_id")
        rows = self.store.read("occurrences", seq).join(live, "version_id", "left_semi").where((T.path_key(F.col("rel_path")) == path.replace("\\", "/").lower()) & (F.col("ordinal") == int(ordinal))).select("evidence_id").limit(2).collect()
        return {"status": "missing" if not rows else "ambiguous" if len(rows) > 1 else "resolved", "evidence_id": rows[0].evidence_id if len(rows) == 1 else None}

    @_bounded_read
    def related(self, item_id: str, depth: int = 1, relation_types: list[str] | None = None) -> dict:
        rows = G.bfs(self.store.read("relations"), item_id, depth, relation_types).orderBy("depth", "source_id", F.desc("weight"), "relation_type", "target_id").limit(1001).collect()
        return {"status": "ok" if rows else "no_match", "item_id": item_id, "relations": [r.asDict() for r in rows[:1000]], "truncated": len(rows) > 1000}

    @_bounded_read
    def neighbours(self, item_id: str, direction: str = "both", relation_type: str | None = None, limit: int = 20, generation_id: str | None = None, cursor: str | None = None) -> dict:
        """Edges in, out or both of an item as of a generation, in pages, each with its effective status."""
        _bounded(limit, 1, 100, "limit")
        key = bytes.fromhex(self.store.manifest()["cursor_key"])
        scope = {"endpoint": "neighbours", "item": item_id, "direction": direction, "type": relation_type, "generation": generation_id}
        after = cursors.read(key, scope, cursor) if cursor else None
        gen = self.store.cursor_generation(after[-1]) if after else self.store.generation(generation_id)
        keys = ["relation_type", "source_id", "target_id", "direction", "created_seq"]
        rows = G.neighbours(self.store.read("relations", gen["seq"]), item_id, direction, relation_type)
        rows = rows.select(*keys, "target_type", "weight", G.effective_status(F.col("status"), F.col("provenance_review")).alias("effective_status"))
        rows = (R.after_key(rows, keys, after[:-1]) if after else rows).orderBy(*keys).limit(limit + 1)
        items = [r.asDict() for r in rows.collect()]
        return cursors.pack_page(items, limit, {"status": "ok" if items else "no_match", "generation": gen["id"]}, lambda x: cursors.sign(key, scope, (*(x[k] for k in keys), gen["id"])))

    @_bounded_read
    def project(self, project_id: str) -> dict:
        """A project with its files, notes and confirmed facts."""
        p = self.store.read("projects").where(F.col("project_id") == project_id).first()
        if p is None:
            raise NotFound(f"project {project_id} is not registered")
        files_ = self._open_memberships().where(F.col("project_id") == project_id).agg(F.count("*").alias("n")).first().n
        notes = self._notes().where((F.col("target_type") == "project") & (F.col("target_id") == _slug(project_id)) & F.col("is_current"))
        fam = notes.where("provenance_review = 'reviewed' AND summary_family IS NOT NULL").groupBy("summary_family").agg(F.count("*").alias("n"), F.min("summary_id").alias("summary_id")).where("n = 1")
        facts = [r.summary_id for r in fam.orderBy("summary_id").limit(101).collect()]
        return {"status": "ok", **p.asDict(), "n_files": files_, "n_current_summaries": notes.count(), "confirmed_facts": facts[:100], "truncated": len(facts) > 100}

    def list_projects(self, limit: int = 1000) -> dict:
        rows = self.store.read("projects").dropDuplicates(["project_id"]).orderBy("project_id").limit(_bounded(limit, 1, 1000, "limit")).collect()
        return {"status": "ok", "projects": [r.asDict() for r in rows]}

    def stats(self) -> dict:
        """Rows per table of the newest generation."""
        g = self.store.generation()
        return {"status": "ok", "generation": g["id"], "seq": g["seq"], "tables": {t: self.store.read(t).count() for t in SCHEMAS}}

    def verify(self) -> dict:
        """Integrity of the newest generation: dangling references and texts that do not match their digest."""
        occ, bodies, versions = (self.store.read(t) for t in ("occurrences", "bodies", "versions"))
        members = self.store.read("memberships").where("NOT tombstone")
        cited = self.store.read("summaries").select(F.explode("evidence_ids").alias("evidence_id"))
        findings = {
            "occurrence_without_body": occ.join(bodies, ["digest", "chars"], "left_anti").count(),
            "membership_without_version": members.join(versions, "version_id", "left_anti").count(),
            "citation_without_evidence": cited.join(occ, "evidence_id", "left_anti").count(),
            "body_digest_wrong": bodies.where(F.sha2("content", 256) != F.col("digest")).count(),
            "version_digest_wrong": versions.where(F.col("raw").isNotNull() & (F.sha2("raw", 256) != F.col("sha256"))).count(),
        }
        return {"status": "ok" if not any(findings.values()) else "failed", "findings": findings}

    def resource(self, uri: str) -> dict:
        """kb://project/ID, kb://graph/ID or kb://summary/ID."""
        kind, _, item = uri.removeprefix("kb://").partition("/")
        calls = {"project": self.project, "graph": self.related, "summary": lambda x: self.summary(int(x))}
        _check(uri.startswith("kb://") and kind in calls and bool(item), "unknown resource")
        return calls[kind](item)


def operation_id(*parts: str) -> str:
    """A stable id for callers that have none."""
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:32]
