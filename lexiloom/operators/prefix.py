"""Ordered scans over groups of any size, in two steps.

Rows are dealt by ranges of (group, order), so a group that holds most of a table lies in many tasks, in
order. Each task scans its part of a group; one row per group and range carries what lies before or
after the range, and is joined back. A plain window would put a whole group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.session import settle


def ranged(rows: DataFrame, group: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_rng``, the number of their range; written, so that a range keeps its rows.

    ``order`` must tell rows of a group apart, otherwise equal ones stay together in one range.
    """
    keys = [*group, *order]
    dealt = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    return settle(dealt.withColumn("_rng", F.spark_partition_id()))


def _carried(rows: DataFrame, carry: DataFrame, group: list[str]) -> DataFrame:
    """``carry`` (group, _rng, _c) joined to the rows, null groups included."""
    named = carry.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_rng").alias("_at"), "_c")
    on = F.col("_rng") == F.col("_at")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(named, on).drop("_at", *(f"_g{k}" for k in range(len(group))))


def running_max(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Adds the largest ``value`` so far in the group; ``rows`` come from ``ranged``."""
    inside = W.partitionBy("_rng", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    sums = rows.groupBy(*group, "_rng").agg(F.max(value).alias("_m"))
    earlier = W.partitionBy(*group).orderBy("_rng").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*group, "_rng", F.max("_m").over(earlier).alias("_c"))
    scanned = rows.withColumn(name, F.max(value).over(inside))
    return _carried(scanned, carry, group).withColumn(name, F.greatest(name, "_c")).drop("_c")


def following(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``value`` of the next row of the group, null on the last; ``rows`` come from ``ranged``."""
    by = W.partitionBy("_rng", *group).orderBy(*order)
    heads = rows.groupBy(*group, "_rng").agg(F.min_by(F.struct(value), F.struct(*order)).alias("_h"))
    carry = heads.select(*group, "_rng", F.lead("_h").over(W.partitionBy(*group).orderBy("_rng"))[value].alias("_c"))
    last = F.row_number().over(W.partitionBy("_rng", *group).orderBy(*(F.col(c).desc() for c in order))) == 1
    scanned = rows.withColumn(name, F.lead(value).over(by)).withColumn("_last", last)
    return _carried(scanned, carry, group).withColumn(name, F.when(F.col("_last"), F.col("_c")).otherwise(F.col(name))).drop("_c", "_last")
