"""MinHash signatures and locality-sensitive hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lexiloom.functions import hashing
from lexiloom.operators.pairs import spread_self_join
from lexiloom.session import settle

NUM_HASHES = hashing.NUM_HASHES


def band_parameters(threshold: float, num_hashes: int = NUM_HASHES) -> tuple[int, int]:
    """(bands, rows) whose S-curve turns nearest to the threshold."""
    options = [(b, num_hashes // b) for b in range(1, num_hashes + 1)]
    return min(options, key=lambda br: abs(math.exp(-math.log(br[0]) / br[1]) - threshold))


def signatures(terms: DataFrame, num_hashes: int = NUM_HASHES) -> DataFrame:
    """(id, sig) from distinct (id, term) rows; documents without terms get none.

    One hash aggregate with a minimum per hash function: combined map-side, all in the JVM.
    """
    hashed = terms.select("id", hashing.fnv1a(F.col("term")).alias("h"))
    family = hashing.hash_family(num_hashes)
    minima = [F.min(hashing.universal(F.col("h"), a, b)).alias(f"m{i}") for i, (a, b) in enumerate(family)]
    wide = hashed.groupBy("id").agg(*minima)
    return wide.select("id", F.array(*[F.col(f"m{i}") for i in range(num_hashes)]).alias("sig"))


def jaccard_estimate(left: Column, right: Column) -> Column:
    same = F.zip_with(left, right, lambda x, y: x == y)
    return F.size(F.filter(same, lambda s: s)) / F.size(left)


def signature_groups(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, members): documents with one signature are handled as one.

    Signatures are costly and read many times, so they are written once.
    """
    keyed = settle(sigs).withColumn("key", hashing.content_hash(F.array_join("sig", ",")))
    reps = keyed.groupBy("key").agg(F.min("id").alias("rep_id"))
    members = keyed.select("id", "key").join(reps, "key").select("id", "rep_id")
    chosen = keyed.select("id", "sig").join(reps.select(F.col("rep_id").alias("id")), "id", "left_semi")
    return chosen, members


def band_buckets(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band, bucket): one row per band; the bucket key is the digest of its values."""
    slices = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.struct(
            b.alias("band"), F.md5(F.array_join(F.slice("sig", b * rows + 1, F.lit(rows)), ",")).alias("bucket")
        ),
    )
    return sigs.select("id", F.inline(slices))


def candidate_pairs(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Distinct (id1, id2) that share a bucket. Buckets of one are dropped before the join."""
    buckets = band_buckets(sigs, bands, rows)
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = buckets.join(sizes, ["band", "bucket"])
    met = spread_self_join(shared, ["band", "bucket"], "size", F.lit(True))
    return met.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def scored_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """(id1, id2, sim): candidates whose estimated Jaccard similarity reaches the threshold."""
    bands, rows = band_parameters(threshold)
    a = sigs.select(F.col("id").alias("id1"), F.col("sig").alias("s1"))
    b = sigs.select(F.col("id").alias("id2"), F.col("sig").alias("s2"))
    both = candidate_pairs(sigs, bands, rows).join(a, "id1").join(b, "id2")
    return both.select("id1", "id2", jaccard_estimate(F.col("s1"), F.col("s2")).alias("sim")).where(
        F.col("sim") >= threshold
    )
