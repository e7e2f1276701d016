"""Continuous ingest: new texts are chunked, deduplicated and appended as they arrive.

An extension: batch refreshes do the same for whole folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataseek.functions.paths import SECRET_TEXT
from strataseek.functions.text import path_key
from strataseek.operators import fulltext as X
from strataseek.operators.chunking import chunk_table
from strataseek.runtime import materialise
from strataseek.store import Store, Transaction


def ingest(documents: DataFrame, store: Store, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append streamed documents (project_id, rel_path, text) to a store.

    Each micro-batch is one operation ``name:batch``, so a batch that runs
    again after a failure changes nothing. Of several texts of a path in a
    batch one version each is kept.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        store.execute("stream", f"{name}:{batch_id}", {"name": name, "batch": batch_id}, lambda txn: append_texts(store, txn, rows))

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def append_texts(store: Store, txn: Transaction, rows: DataFrame) -> dict:
    """Versions, memberships and evidence of texts that may be indexed.

    ``rows``: project_id, rel_path, text. A path whose newest version holds
    the same text is left alone; of several texts of a path the greatest is
    kept. Texts with a literal secret get a version without text, and no
    evidence. A text that was once appended can be retired by a later refresh
    or replaced by a later text of its path, like any other.
    """
    texts = rows.where("text IS NOT NULL AND text <> ''").withColumn("path_key", path_key(F.col("rel_path")))
    texts = texts.groupBy("project_id", "path_key").agg(F.max(F.struct("rel_path", "text")).alias("x")).select("project_id", "path_key", "x.rel_path", "x.text")
    texts = texts.withColumn("sha256", F.sha2("text", 256)).withColumn("size", F.octet_length("text").cast("long"))
    log = store.read("memberships").groupBy("project_id", "path_key").agg(F.max(F.struct("valid_from", "version_id", "tombstone")).alias("m")).where("NOT m.tombstone").select("project_id", "path_key", F.col("m.version_id").alias("version_id"))
    now = log.join(store.read("versions").select("version_id", F.col("sha256").alias("held")), "version_id").select("project_id", "path_key", "held")
    fresh = texts.join(now, ["project_id", "path_key"], "left").where("held IS NULL OR held <> sha256").withColumn("action", F.when(F.col("held").isNull(), "new").otherwise("new_version"))
    fresh = fresh.withColumn("version_id", F.sha2(F.concat_ws("\x1f", "project_id", "path_key", "sha256", F.lit(str(txn.seq))), 256))
    secret = F.col("text").rlike(SECRET_TEXT)
    fresh = materialise(fresh.select("version_id", "project_id", "path_key", "rel_path", "sha256", "size", "action", F.when(secret, "secret_content").alias("reason"), F.when(~secret, F.col("text")).alias("text")))
    versions = txn.append("versions", fresh.withColumns({"kind": F.lit("text"), "raw": F.lit(None).cast("binary"), "modified": F.lit(None).cast("timestamp")}))
    txn.append("memberships", fresh.withColumns({"valid_from": F.lit(txn.seq), "tombstone": F.lit(False)}))
    return {"status": "appended", "n_evidence": append_evidence(store, txn, versions)}


def append_evidence(store: Store, txn: Transaction, versions: DataFrame) -> int:
    """Bodies, occurrences and postings of the texts of new versions; bodies already held are not written again.

    Chunks are cut once and written before they are used; only digests meet
    the bodies held, and only chunks with a new digest are written.
    """
    texts = versions.where("text IS NOT NULL AND text <> '' AND reason IS NULL")
    chunks = chunk_table(texts.select("version_id", "text"), "version_id", "text").withColumn("digest", F.sha2("content", 256)).withColumn("chars", F.length("content").cast("long"))
    chunks = materialise(chunks.join(texts.select("version_id", "project_id", "rel_path"), "version_id"))
    held = store.read("bodies").select("digest", "chars")
    firsts = chunks.groupBy("digest", "chars").agg(F.min(F.struct("version_id", "ordinal")).alias("x")).select("digest", "chars", "x.*").join(held, ["digest", "chars"], "left_anti")
    txn.append("bodies", chunks.select("version_id", "ordinal", "digest", "chars", "content").join(firsts, ["version_id", "ordinal", "digest", "chars"], "left_semi"))
    before = Window.partitionBy("version_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.drop("content").withColumn("char_start", F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long")).withColumn("char_end", F.col("char_start") + F.col("chars"))
    evidence_id = F.substring(F.sha2(F.concat_ws("\x1f", "version_id", "ordinal"), 256), 1, 32)
    n = txn.append("occurrences", placed.withColumn("evidence_id", evidence_id)).count()
    index_texts(txn, chunks.select(evidence_id.alias("doc"), "content"), 1)
    return n


def index_texts(txn: Transaction, docs: DataFrame, domain: int) -> None:
    """Postings and statistics of new documents (doc, content) of a domain: 0 for notes, 1 for evidence."""
    txn.append("postings", X.postings(docs, "doc", "content", domain))
    txn.append("index_stats", X.corpus(docs, "content", domain))
