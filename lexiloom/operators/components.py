"""Clusters of a pair graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.session import settle


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component): the smallest member id labels each component of (id1, id2) edges.

    Alternates large-star and small-star rewiring, so the rounds grow with the logarithm of the
    diameter. Both are a minimum per node and a join; a hub is never collected.
    """
    edges = settle(
        pairs.select(F.greatest("id1", "id2").alias("u"), F.least("id1", "id2").alias("v")).where("u <> v").distinct()
    )

    def digest(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours move to the smallest neighbour.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: the node and its smaller neighbours move to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        fresh = settle(moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = digest(fresh)
        edges = fresh
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def greedy_stars(pairs: DataFrame) -> DataFrame:
    """(id, centre): in ascending order each unassigned node takes its unassigned neighbours.

    Nodes without a smaller open neighbour become centres together, round by round; that gives
    the sequential result, since only smaller neighbours can claim or block a node.
    """
    edges = settle(pairs.select("id1", "id2").where("id1 < id2").distinct())
    nodes = edges.select(F.col("id1").alias("id")).unionByName(edges.select(F.col("id2").alias("id"))).distinct()
    done = settle(nodes.select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("centre")).where(F.lit(False)))
    open_nodes = settle(nodes)
    while True:
        live = edges.join(open_nodes.select(F.col("id").alias("id1")), "id1", "left_semi").join(
            open_nodes.select(F.col("id").alias("id2")), "id2", "left_semi"
        )
        blocked = live.select(F.col("id2").alias("id")).distinct()
        centres = open_nodes.join(blocked, "id", "left_anti")
        # A member goes to its smallest centre only if no open smaller neighbour could claim it first.
        offers = live.join(centres.select(F.col("id").alias("id1")), "id1", "left_semi")
        first_claim = live.groupBy("id2").agg(F.min("id1").alias("lowest"))
        taken = offers.join(first_claim, "id2").groupBy("id2", "lowest").agg(F.min("id1").alias("centre"))
        taken = taken.where("centre = lowest").select(F.col("id2").alias("id"), "centre")
        fresh = settle(centres.select("id", F.col("id").alias("centre")).unionByName(taken))
        done = done.unionByName(fresh)
        open_nodes = settle(open_nodes.join(fresh.select("id"), "id", "left_anti"))
        if open_nodes.isEmpty():
            return done


def component_sizes(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component, members, pairs) of clusters with at least two members."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    inside = pairs.join(labels, pairs["id1"] == labels["id"]).groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    return sizes.where("members >= 2").join(inside, "component")
