"""The best partners of each query vector through an impact-ordered index with upper bounds.

Every term knows the largest weight that any item gives it, so the most that a term can add to a query's
score is known before its postings are read. Each query first meets the strongest postings of its terms
only; the k-th best of these partial scores is a floor under its k-th best score. Terms, most frequent
ones first, are then set aside while all of them together stay below the floor: an item that holds no
other term cannot count. The remaining, rarer terms are joined, partial scores that cannot reach the floor
even with all set-aside terms fall away, and only survivors are completed with the frequent terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexiloom.session import settle

CHAMPIONS = 64
SLACK = 1e-6


def unit_rows(rows: DataFrame) -> DataFrame:
    """(id, term, w) with vectors of length 1."""
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return rows.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def champions(items: DataFrame, most: int = CHAMPIONS) -> DataFrame:
    """The ``most`` strongest postings of each term; a task keeps no more than these per term."""
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("rw"), "rid"))
    return items.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def kth_scores(partial: DataFrame, k: int) -> DataFrame:
    """(lid, kth): the k-th best partial score, of queries that met at least k items."""
    rank = F.row_number().over(W.partitionBy("lid").orderBy(F.desc("part"), "rid"))
    return partial.withColumn("_r", rank).where(F.col("_r") == k).select("lid", F.col("part").alias("kth"))


def split_terms(queries: DataFrame, tops: DataFrame, floors: DataFrame) -> DataFrame:
    """(lid, term, lw, essential, aside): aside is the most that a query's set-aside terms can add.

    In order of falling frequency, terms are set aside as long as the sum of their bounds stays below the
    query's floor. The window runs over the terms of one query.
    """
    bound = F.col("lw") * F.col("top")
    met = queries.join(tops, "term").withColumn("bound", bound).join(floors, "lid", "left")
    frequent_first = W.partitionBy("lid").orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    met = met.withColumn("so_far", F.sum("bound").over(frequent_first))
    met = met.withColumn("essential", F.col("so_far") >= F.coalesce("floor", F.lit(0.0)))
    aside = F.max(F.when(~F.col("essential"), F.col("so_far"))).over(W.partitionBy("lid"))
    return met.select("lid", "term", "lw", "essential", F.coalesce(aside, F.lit(0.0)).alias("aside"), F.coalesce("floor", F.lit(0.0)).alias("floor"))


def best_pairs(left: DataFrame, right: DataFrame, k: int, threshold: float) -> DataFrame:
    """(lid, rid, sim): cosine of (id, term, w) rows, rounded to six decimals.

    Holds every pair from ``threshold`` on and the ``k`` best of each left id, with exact scores; other
    pairs that share a term may be absent.
    """
    queries = settle(unit_rows(left).toDF("lid", "term", "lw"))
    items = settle(unit_rows(right).toDF("rid", "term", "rw").join(queries.select("term").distinct(), "term", "left_semi"))
    tops = items.groupBy("term").agg(F.max("rw").alias("top"), F.count(F.lit(1)).alias("df"))
    first = queries.join(champions(items), "term").groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("part"))
    floors = kth_scores(first, k).select("lid", (F.least("kth", F.lit(threshold)) - SLACK).alias("floor"))
    terms = settle(split_terms(queries, tops, floors))
    limits = terms.select("lid", "aside", "floor").distinct()
    met = terms.where("essential").join(items, "term").groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("part"))
    survivors = settle(met.join(limits, "lid").where("part + aside >= floor").select("lid", "rid", "part"))
    rest = survivors.select("lid", "rid").join(terms.where("not essential").select("lid", "term", "lw"), "lid").join(items, ["rid", "term"])
    added = rest.groupBy("lid", "rid").agg(F.sum(F.col("lw") * F.col("rw")).alias("more"))
    whole = survivors.join(added, ["lid", "rid"], "left")
    sim = F.least(F.col("part") + F.coalesce("more", F.lit(0.0)), F.lit(1.0))
    return whole.select("lid", "rid", F.round(sim, 6).alias("sim"))
