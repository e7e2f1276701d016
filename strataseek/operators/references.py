"""References to records that do not exist.

Children and parents are put into one long form of tagged keys, grouped by
parent table and key; only groups that cannot vouch for all their references
are kept and their references counted by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.operators.skew import join_facts
from strataseek.runtime import materialise

KEYS = ["ref_table", "ref_id"]


def key_states(references: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per parent table and key: parent flag, life span, number and time span of its references.

    ``references``: ref_table, ref_id, ref_at; ``parents``: ref_table, ref_id,
    valid_from, valid_to (either may be null: no bound). References are counted
    on the map side first, so a key named by a third of all rows is a few
    partial rows in the shuffle. Several rows of a parent count as one that
    exists from the earliest valid_from and ends at the earliest valid_to.
    """
    tagged = references.select(*KEYS, F.lit(0).alias("is_parent"), F.lit(1).cast("long").alias("n"), F.col("ref_at").alias("at"), F.lit(None).cast("timestamp").alias("since"), F.lit(None).cast("timestamp").alias("until"))
    tagged = tagged.unionByName(parents.select(*KEYS, F.lit(1).alias("is_parent"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("at"), F.col("valid_from").alias("since"), F.col("valid_to").alias("until")))
    return tagged.where("ref_table IS NOT NULL AND ref_id IS NOT NULL").groupBy(*KEYS).agg(
        F.max("is_parent").alias("is_parent"), F.sum("n").alias("n_refs"), F.min("at").alias("first_ref"), F.max("at").alias("last_ref"), F.min("since").alias("since"), F.min("until").alias("until")
    )


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent is missing, later than the reference, or gone by then.

    Adds ``reason`` (missing, later, ended). Groups whose parent covers the
    whole time span of its references are dropped before the join back; there
    a key named by a large part of all references meets them by broadcast. A reference without time (null ref_at) is an orphan only if
    its parent is missing; null tables or ids never are. Repeated references
    stay repeated; empty inputs give no rows; other columns are kept, but one
    named ``reason`` is replaced.
    """
    rows = materialise(references)
    suspect = key_states(rows, parents).where("n_refs > 0 AND (is_parent = 0 OR first_ref < since OR last_ref >= until)")
    suspect = materialise(suspect.select(*KEYS, *(F.col(c).alias(f"__{c}") for c in ("is_parent", "since", "until", "n_refs"))))
    joined = join_facts(rows, suspect, KEYS, "__n_refs", rows.count())
    reason = F.when(F.col("__is_parent") == 0, "missing").when(F.col("ref_at") < F.col("__since"), "later").when(F.col("ref_at") >= F.col("__until"), "ended")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("__is_parent", "__since", "__until", "__n_refs")


def orphan_report(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Counts of orphan references per parent table, reason and month: ref_table, period, reason, n_orphans."""
    found = orphans(references, parents).withColumn("period", F.date_format(F.col("ref_at"), "yyyy-MM"))
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_orphans"))
