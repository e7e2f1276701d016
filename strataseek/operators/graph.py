"""Property-graph edges between projects and tags, and bounded traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.runtime import materialise

#: Edges followed from one node, by weight, type and target.
FANOUT = 80
EDGE = ["source_id", "target_type", "target_id", "relation_type", "weight"]
# Weights of the edges.
W_TECHNOLOGY, W_DOMAIN, W_NAME = 1.0, 0.6, 0.25


def tag_edges(tags: DataFrame) -> DataFrame:
    """Edges from projects to their tags. ``tags``: project_id, kind (technology, domain), tag, distinct."""
    kind = F.col("kind") == "technology"
    return tags.select(
        F.col("project_id").alias("source_id"), F.lit("concept").alias("target_type"), F.col("tag").alias("target_id"),
        F.when(kind, "uses_technology").otherwise("has_domain").alias("relation_type"), F.when(kind, W_TECHNOLOGY).otherwise(W_DOMAIN).alias("weight"),
    )


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Ordered pairs of different projects that share a value, with the number of values shared."""
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by] + [F.col("a.project_id") != F.col("b.project_id")]
    kind = [F.col("a.kind")] if "kind" in by else []
    return a.join(b, on).groupBy(F.col("a.project_id").alias("source_id"), F.col("b.project_id").alias("target_id"), *kind).agg(F.count("*").alias("n"))


def project_edges(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between projects, both ways.

    shares_technology weighs min(1, n / 4) and same_domain min(0.8, n / 4)
    with n shared tags; candidate_name_overlap (0.25) joins projects without
    another edge whose names share two words or more. ``names``: project_id,
    word, distinct. Registries of projects are small by nature, but pairs are
    made only within a shared tag.
    """
    n = F.col("n") / 4
    shared = _pairs(tags, ["kind", "tag"]).select(
        "source_id", F.lit("project").alias("target_type"), "target_id",
        F.when(F.col("kind") == "technology", "shares_technology").otherwise("same_domain").alias("relation_type"),
        F.when(F.col("kind") == "technology", F.least(F.lit(1.0), n)).otherwise(F.least(F.lit(0.8), n)).alias("weight"),
    )
    alike = _pairs(names, ["word"]).where("n >= 2").join(shared, ["source_id", "target_id"], "left_anti")
    return shared.unionByName(alike.select("source_id", F.lit("project").alias("target_type"), "target_id", F.lit("candidate_name_overlap").alias("relation_type"), F.lit(W_NAME).alias("weight")))


def top_edges(edges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """At most ``fanout`` edges per source: heaviest first, then by type and target."""
    w = Window.partitionBy("source_id").orderBy(F.desc("weight"), "relation_type", "target_id")
    return edges.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= fanout).drop("__rn")


def bfs(edges: DataFrame, start: str, depth: int, relation_types: list[str] | None = None) -> DataFrame:
    """Edges reached from ``start`` within ``depth`` (1 to 4) steps, with the depth of their source plus one.

    Only targets of type project that were not seen before are expanded. The
    edges are cut to their fan-out once; each step joins the frontier to them
    and is written, so no step repeats the one before.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth must be from 1 to 4")
    e = edges.where(F.col("relation_type").isin(relation_types)) if relation_types else edges
    e = materialise(top_edges(e))
    frontier = edges.sparkSession.createDataFrame([(start,)], "source_id string")
    seen, out = frontier, []
    for d in range(1, depth + 1):
        found = materialise(e.join(frontier, "source_id").withColumn("depth", F.lit(d)))
        out.append(found)
        if d < depth:
            frontier = materialise(found.where("target_type = 'project'").select(F.col("target_id").alias("source_id")).distinct().join(seen, "source_id", "left_anti"))
            seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, out)


def effective_status(status: Column, review: Column) -> Column:
    """confirmed only for what is marked so and reviewed; candidate as marked; else unconfirmed."""
    return F.when((status == "confirmed") & (review == "reviewed"), "confirmed").when(status == "candidate", "candidate").otherwise("unconfirmed")


def neighbours(edges: DataFrame, item: str, direction: str = "both", relation_type: str | None = None) -> DataFrame:
    """Edges in, out or both of an item, each with its direction."""
    if direction not in ("in", "out", "both"):
        raise ValueError("direction must be in, out or both")
    e = edges.where(F.col("relation_type") == relation_type) if relation_type else edges
    out = e.where(F.col("source_id") == item).withColumn("direction", F.lit("out"))
    into = e.where(F.col("target_id") == item).withColumn("direction", F.lit("in"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)
