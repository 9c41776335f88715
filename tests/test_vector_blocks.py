"""Blocks of vectors: all pairs whatever the cut, and meetings that never become rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import lexical as lx, pairs as pr, vector_blocks as vb
from tests.rows import most_rows


def corpus(spark, n=240, kind="bigint"):
    rng = random.Random(11)
    words = [f"w{k:03d}" for k in range(400)]
    texts = [rng.choices(words, [1 / (k + 5) for k in range(400)], k=rng.choice([5, 30, 60])) for _ in range(n)]
    for k in range(0, n, 4):
        texts[k] = [*texts[(k * 7 + 1) % n][:-1], rng.choice(words)]
    return spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id bigint, text string").select(F.col("id").cast(kind).alias("doc_id"), "text")


def every_pair(docs, strategy, threshold):
    weights, kind = pr.strategy_weights(docs, strategy)
    scale = weights.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    if kind == "cosine":
        weights = weights.join(scale, "id").withColumn("w", F.col("w") / F.col("norm"))
    vectors = pr.packed_vectors(weights)
    pairs = vectors.select(F.col("id").alias("id1")).join(vectors.select(F.col("id").alias("id2")), F.col("id1") < F.col("id2"))
    return {(r["id1"], r["id2"]): r["sim"] for r in pr.score_pairs(pairs, vectors, kind).collect() if r["sim"] >= threshold}


@pytest.mark.parametrize("strategy,threshold,kind", [("tfidf", 0.8, "bigint"), ("tfidf", 0.3, "string"), ("bm25", 0.6, "int"), ("jsd", 0.8, "bigint"), ("jsd", 0.4, "bigint")])
def test_blocks_find_every_pair(spark, monkeypatch, strategy, threshold, kind):
    docs = corpus(spark, 120, kind)
    # Several blocks in each of several files, and slices of a few meetings.
    for name, value in (("BLOCK_ENTRIES", 300), ("SMALL_ENTRIES", 1000), ("LEAST_BLOCKS", 3)):
        monkeypatch.setattr(vb, name, value)
    found = {(r["id1"], r["id2"]): r["sim"] for r in pr.compare(docs, strategy, threshold).collect()}
    assert found == every_pair(docs, strategy, threshold)
    assert len(found) > 10


def test_terms_are_numbered_by_frequency(spark):
    tf = lx.corpus_tf(corpus(spark))
    rows = vb.numbered_terms(lx.document_frequency(tf, "copies")).orderBy("df", "term").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("strategy,threshold", [("tfidf", 0.5), ("bm25", 0.6), ("jsd", 0.6), ("hybrid", 0.5)])
def test_meetings_do_not_become_rows(spark, strategy, threshold):
    docs = corpus(spark, 600)
    entries = lx.corpus_tf(docs).count()
    found, most = most_rows(spark, lambda: pr.compare(docs, strategy, threshold).count())
    # The tokens of the texts, their entries and the answer.
    tokens = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert most <= max(tokens, entries, found)
