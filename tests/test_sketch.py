"""Sketches of documents: never below the similarity, and few meetings of unlike texts pass."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import pairs as pr


def corpus(spark):
    rng = random.Random(5)
    words = [f"w{k:04d}" for k in range(900)]
    texts = [rng.choices(words, [1 / (k + 20) for k in range(900)], k=rng.choice([6, 40, 90])) for _ in range(90)]
    for k in range(20):
        near = list(texts[k])
        near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(near)
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")


@pytest.mark.parametrize("strategy,threshold", [("tfidf", 0.8), ("bm25", 0.5), ("jsd", 0.8), ("jsd", 0.5)])
def test_room_bounds_every_pair_and_prunes(spark, strategy, threshold):
    weights, kind = pr.strategy_weights(corpus(spark), strategy)
    held = pr.indexed_vectors(weights, kind, threshold)
    a, b = held.alias("a"), held.alias("b")
    every = a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), pr.sketch_room(kind).alias("room"))
    scored = pr.score_pairs(every, held.select("id", "vec"), kind).collect()
    assert len(scored) > 5000
    assert [r for r in scored if r["room"] < r["sim"] - 1e-6] == []
    met = {tuple(r) for r in pr.candidate_pairs(held, kind, threshold).collect()}
    assert {(r["id1"], r["id2"]) for r in scored if r["sim"] >= threshold} <= met
    unlike = [r for r in scored if r["sim"] < threshold]
    assert threshold < 0.8 or sum(r["room"] >= threshold for r in unlike) < 0.1 * len(unlike)
