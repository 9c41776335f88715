"""Vectors with ids beyond the exact range of doubles, next to a repeated row."""

from lexiloom.llm import topk
from pyspark.sql import functions as F


def test_large_ids_stay_apart_when_a_row_repeats(spark):
    base = 1 << 60
    rows = [(base + k, [0.1 * k, 0.5]) for k in range(6)] + [(base + 3, [0.3, 0.5])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == base, 5).collect()
    assert {r["vec_id"] for r in found} == {base + k for k in range(1, 6)}
