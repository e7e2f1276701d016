"""Generations, lineages and versioned membership over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.runtime import materialise


def lineages(generations: DataFrame) -> DataFrame:
    """id, ancestor, depth: every generation with itself (depth 0) and its published ancestors.

    ``generations``: id, parent_id, state. Links are followed by doubling, so a
    chain of n generations takes about log2(n) joins; a parent that is missing
    or not published ends the lineage.
    """
    g = generations.where("state = 'published'").select("id", "parent_id").dropDuplicates(["id"])
    known = g.select(F.col("id").alias("ancestor"))
    jumps = materialise(g.where("parent_id IS NOT NULL").join(known, g.parent_id == F.col("ancestor")).select("id", "ancestor", F.lit(1).cast("long").alias("depth")))
    out = materialise(g.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("depth")))
    while True:
        # out holds ancestors nearer than 2^k, jumps those at exactly 2^k
        step = out.alias("o").join(jumps.alias("j"), F.col("o.ancestor") == F.col("j.id"))
        further = step.select("o.id", "j.ancestor", (F.col("o.depth") + F.col("j.depth")).alias("depth"))
        if jumps.isEmpty():
            return out
        out = materialise(out.unionByName(further))
        twice = jumps.alias("a").join(jumps.alias("b"), F.col("a.ancestor") == F.col("b.id"))
        jumps = materialise(twice.select("a.id", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")))


def close_out(log: DataFrame, key: list[str], start: str) -> DataFrame:
    """valid_to of each row of an append-only log: the start of the next row of its key, null for the open one."""
    return log.withColumn("valid_to", F.lead(start).over(Window.partitionBy(*key).orderBy(start)))


def as_of(memberships: DataFrame, seq: int, history: bool = False) -> DataFrame:
    """Memberships born by ``seq`` and no tombstone; without ``history`` only those not ended by then."""
    born = memberships.where((F.col("valid_from") <= seq) & ~F.coalesce(F.col("tombstone").cast("boolean"), F.lit(False)))
    return born if history else born.where(F.col("valid_to").isNull() | (F.col("valid_to") > seq))


def superseded(notes: DataFrame) -> DataFrame:
    """Adds is_superseded and is_current to notes (id, supersedes_id, record_type)."""
    gone = notes.where("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("id"), F.lit(True).alias("is_superseded")).distinct()
    out = notes.join(gone, "id", "left").withColumn("is_superseded", F.coalesce("is_superseded", F.lit(False)))
    return out.withColumn("is_current", ~F.col("is_superseded") & (F.coalesce("record_type", F.lit("legacy_unknown")) != "legacy_unknown"))


def refresh_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a refresh has to do per path: project_id, rel_path, action, moved_from.

    ``old``, ``new``: project_id, rel_path, sha256, size, modified (any
    comparable time), one row per path. unchanged (same digest and size, or
    same size and time where a digest is null), new_version, tombstone, new; a
    new path whose digest and size belong to exactly one path that is gone,
    and to no other new path, is a rename, and that path renamed_away. Where
    both digests are null and the size alone tells so, the new path is a
    possible_move, and the old one stays a tombstone. Null digests match
    nothing, null times neither.
    """
    cols = lambda df, p: df.select("project_id", "rel_path", *(F.col(c).alias(f"{p}_{c}") for c in ("sha256", "size", "modified")), F.lit(True).alias(f"{p}_is"))
    j = cols(old, "o").join(cols(new, "n"), ["project_id", "rel_path"], "full")
    size = F.col("o_size").eqNullSafe(F.col("n_size"))
    digests = F.col("o_sha256").isNotNull() & F.col("n_sha256").isNotNull()
    same = F.when(digests, (F.col("o_sha256") == F.col("n_sha256")) & size).otherwise(size & F.coalesce(F.col("o_modified") == F.col("n_modified"), F.lit(False)))
    action = F.when(F.col("o_is").isNull(), "new").when(F.col("n_is").isNull(), "tombstone").when(same, "unchanged").otherwise("new_version")
    acts = j.withColumn("action", action)

    def single(kind: str, p: str) -> DataFrame:
        """Digest and size that one path only has among those with an action; a null digest is a value of its own."""
        rows = acts.where(F.col("action") == kind).groupBy("project_id", F.coalesce(f"{p}_sha256", F.lit("")).alias("sha"), F.col(f"{p}_size").alias("size"))
        return rows.agg(F.min("rel_path").alias(f"{p}_path"), F.count("*").alias(f"{p}_n")).where(f"{p}_n = 1")

    moves = single("tombstone", "o").join(single("new", "n"), ["project_id", "sha", "size"]).select("project_id", F.col("n_path").alias("rel_path"), F.col("o_path").alias("moved_from"), (F.col("sha") != "").alias("sure"))
    taken = moves.where("sure").select("project_id", F.col("moved_from").alias("rel_path"), F.lit(True).alias("gone"))
    out = acts.select("project_id", "rel_path", "action").join(moves, ["project_id", "rel_path"], "left").join(taken, ["project_id", "rel_path"], "left")
    final = F.when(F.col("sure"), "renamed").when(~F.col("sure"), "possible_move").when(F.coalesce("gone", F.lit(False)) & (F.col("action") == "tombstone"), "renamed_away").otherwise(F.col("action"))
    return out.select("project_id", "rel_path", final.alias("action"), "moved_from")


def latest_per_key(df: DataFrame, key: list[str], *order: Column, smallest: bool = False) -> DataFrame:
    """The row of each key with the greatest (or smallest) ``order``, which must be total; nulls are smallest.

    Reduced on the map side, so a hot key is no hot task.
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by if smallest else F.max_by
    one = df.groupBy(*key).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return one.select(*(F.col(c) if c in key else F.col("__row")[c].alias(c) for c in df.columns))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, repeated rows counted: side, then the columns; empty for equal relations."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
