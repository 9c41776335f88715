"""Ordered scans in ranges against plain windows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from lexiloom.operators import align as al, prefix as px


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_scans_equal_windows_with_one_hot_group(spark, ranges):
    rnd = random.Random(ranges)
    rows = [(g, i, rnd.choice([None, rnd.randint(0, 50)])) for i in range(300) for g in ("hot", "x" if i % 20 == 0 else "hot2", None if i % 50 == 0 else "y")]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    dealt = px.ranged(df, ["g"], ["i"], ranges)
    if ranges > 1:
        assert dealt.where("g = 'hot'").select("_rng").distinct().count() > 1
    w = W.partitionBy("g").orderBy("i")
    for inclusive in (True, False):
        got = px.running_max(dealt, ["g"], ["i"], F.col("v"), "m", inclusive).select("g", "i", "m")
        want = df.withColumn("m", F.max("v").over(w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))).select("g", "i", "m")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    got = px.following(dealt, ["g"], ["i"], "v", "n").select("g", "i", "n")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.withColumn("n", F.lead("v").over(w)).select("g", "i", "n").collect()))


def test_contiguous_units_of_one_file(spark):
    units = [("f", "k", s, s + 2, n) for n, s in enumerate([1, 3, 6, 10, 11, 20, 2])]
    found = al.contiguous_groups(spark.createDataFrame(units, "file string, kind string, start_line int, end_line int, id int")).collect()
    assert {r["id"]: r["group_start"] for r in found} == {0: 1, 6: 1, 1: 1, 2: 1, 3: 10, 4: 10, 5: 20}
    assert al.contiguous_groups(spark.createDataFrame([], "file string, kind string, start_line int, end_line int, id int")).collect() == []
