"""Snapshot comparison: changed, stale and deleted items, reuse of earlier decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, page, change) from two (id, page, h) snapshots."""
    a = old.select("id", F.col("page").alias("old_page"), F.col("h").alias("old_h"))
    both = a.join(new.select("id", F.col("page").alias("new_page"), F.col("h").alias("new_h")), "id", "full_outer")
    change = (
        F.when(F.col("old_h").isNull(), "added")
        .when(F.col("new_h").isNull(), "deleted")
        .when(F.col("old_h") == F.col("new_h"), "unchanged")
        .otherwise("modified")
    )
    return both.select("id", F.coalesce("old_page", "new_page").alias("page"), change.alias("change"))


def stale_units(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(id, state): units to rebuild and units to remove."""
    changed = classify(manifest, current).where("change <> 'unchanged'")
    return changed.select("id", F.when(F.col("change") == "deleted", "deleted").otherwise("stale").alias("state"))


def page_actions(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Per page the number of changes by type and what to do about them; pages that ``known`` (page)
    lacks are seen for the first time and have nothing to be changed yet."""
    seen = changes.where("change <> 'unchanged'").join(known.select("page").distinct(), "page", "left_semi")
    counts = seen.groupBy("page").agg(
        *[F.count_if(F.col("change") == c).alias(c) for c in ("modified", "added", "deleted")]
    )
    return counts.withColumn("action", F.when(F.col("deleted") > 0, "review").otherwise("update"))


def reuse_decisions(current: DataFrame, decided: DataFrame) -> DataFrame:
    """(id, decision): an earlier decision stands while the digest is the same, else 'pending'."""
    both = current.select("id", "h").join(decided.select("id", "h", "decision"), ["id", "h"], "left")
    return both.select("id", F.coalesce("decision", F.lit("pending")).alias("decision"))


def manifest_states(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(id, state): valid, outdated, missing from the manifest, or orphaned in it."""
    names = F.create_map(
        F.lit("added"), F.lit("missing"), F.lit("deleted"), F.lit("orphaned"),
        F.lit("unchanged"), F.lit("valid"), F.lit("modified"), F.lit("outdated"),
    )
    return classify(manifest, current).select("id", names[F.col("change")].alias("state"))
