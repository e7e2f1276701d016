"""What changed between full snapshots, from validity intervals (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Scans up to this number are broadcast (about 20 MB); beyond it they are joined by shuffle.
JOBS_MAX = 500_000


def last_delivered(deliveries: DataFrame, keys: list[str], order: str, payload: list[str]) -> DataFrame:
    """The row of each key delivered last; exact duplicates count once, ties take the greatest payload, nulls last."""
    best = F.max(F.struct(order, *payload)).alias("row")
    return deliveries.groupBy(*keys).agg(best).select(*keys, "row.*")


def intervals(rows: DataFrame, keys: list[str], step: str, same: Column) -> DataFrame:
    """Islands of equal state over consecutive steps.

    ``rows``: one row per key and step; ``same`` compares a row with the struct
    column ``prev`` of the preceding row of its key. Result: keys, first_step,
    last_step, prev_last, next_first (null where there is none). A key has at
    most as many rows as there are snapshots, so a window is bounded however
    many keys there are.
    """
    w = Window.partitionBy(*keys).orderBy(step)
    cols = [c for c in rows.columns if c not in keys]
    seen = rows.withColumn("prev", F.lag(F.struct(*cols)).over(w))
    starts = F.when(F.col(f"prev.{step}").isNull() | (F.col(f"prev.{step}") != F.col(step) - 1) | ~same, 1).otherwise(0)
    marked = seen.withColumn("_island", F.sum(starts).over(w))
    # islands of a key are contiguous, so the same partitioning serves this grouping
    spans = marked.groupBy(*keys, "_island").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"))
    v = Window.partitionBy(*keys).orderBy("_island")
    return spans.select(*keys, "first_step", "last_step", F.lag("last_step").over(v).alias("prev_last"), F.lead("first_step").over(v).alias("next_first"))


def change_events(spans: DataFrame, keys: list[str], steps: DataFrame, group: str) -> DataFrame:
    """Events added, removed and changed from validity intervals.

    ``steps``: group, last_of_group (number of its snapshots). An island that
    starts right after another is a change, one that starts otherwise an
    addition (not at the first snapshot); an island that ends without a
    neighbour before the last snapshot is a removal at the next one.
    Result: keys, step, change_type.
    """
    s = spans.join(steps, group)
    start = F.when(F.col("prev_last") == F.col("first_step") - 1, "changed").when(F.col("first_step") > 1, "added")
    end = F.when((F.col("last_step") < F.col("last_of_group")) & (F.col("next_first").isNull() | (F.col("next_first") != F.col("last_step") + 1)), "removed")
    pairs = F.array(F.struct(F.col("first_step").alias("step"), start.alias("change_type")), F.struct((F.col("last_step") + 1).alias("step"), end.alias("change_type")))
    return s.select(*keys, F.explode(F.filter(pairs, lambda p: p["change_type"].isNotNull())).alias("e")).select(*keys, "e.step", "e.change_type")


def file_changes(jobs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Files added, removed and changed from each committed scan of a project to its next one.

    ``jobs``: project_id, scan_no, state; ``deliveries``: project_id, scan_no,
    rel_path, loaded_at, sha256, size, mtime. A file is its project and path
    (``/``, no leading ``./``, lower case); of several rows in a scan the one
    loaded last counts. Digests compare without case; where either is null,
    size and whole seconds of mtime decide. Rows of failed or unknown scans,
    and rows without project, scan or path, are left out. ``jobs`` grows with
    projects and scans only and is broadcast for that (see ``JOBS_MAX``).
    Result, distinct: scan_no (the later scan), project_id, rel_path, change_type.
    """
    from strataseek.functions.text import path_key

    ordered = jobs.where("state = 'committed' AND project_id IS NOT NULL AND scan_no IS NOT NULL").select("project_id", "scan_no").distinct()
    w = Window.partitionBy("project_id").orderBy("scan_no")
    ordinals = ordered.select("project_id", "scan_no", F.row_number().over(w).alias("step"))
    sizes = ordinals.groupBy("project_id").agg(F.max("step").alias("last_of_group"))
    small = ordinals.limit(JOBS_MAX + 1).count() <= JOBS_MAX
    hint = F.broadcast if small else (lambda df: df)
    keys = ["project_id", "rel_path"]
    rows = deliveries.select("project_id", "scan_no", path_key(F.col("rel_path")).alias("rel_path"), "loaded_at", F.lower(F.trim("sha256")).alias("sha256"), "size", F.floor("mtime").alias("second"))
    rows = rows.where("rel_path IS NOT NULL").join(hint(ordinals), ["project_id", "scan_no"])
    # one exchange on the file serves the reduction, the islands and their neighbours
    rows = last_delivered(rows.repartition(*keys), [*keys, "step"], "loaded_at", ["sha256", "size", "second"]).drop("loaded_at")
    same = F.when(F.col("sha256").isNull() | F.col("prev.sha256").isNull(), F.col("size").eqNullSafe(F.col("prev.size")) & F.col("second").eqNullSafe(F.col("prev.second"))).otherwise(F.col("sha256") == F.col("prev.sha256"))
    events = change_events(intervals(rows, keys, "step", same), keys, hint(sizes), "project_id")
    return events.join(hint(ordinals), ["project_id", "step"]).select("scan_no", *keys, "change_type")
