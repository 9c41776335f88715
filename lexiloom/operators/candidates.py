"""Candidates for a user-supplied pair score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import lexical as lx, pairs as pr


def prefiltered_scores(docs: DataFrame, threshold: float, score, keep: float | None = None) -> DataFrame:
    """(id1, id2, sim): candidates at half the threshold, scored by ``score(words1, words2)``.

    Candidates are the pairs of distinct texts whose TF-IDF cosine reaches half the threshold, by the
    exact term join at any size, and each copy with its representative.
    """
    weights, kind, entries = pr.corpus_weights(docs, "tfidf")
    near = pr.similar_pairs(weights, kind, threshold * pr.CANDIDATE_RELAXATION, entries)
    found = pr.with_copies(near, lx.copy_members(docs)).select("id1", "id2")
    # A pair takes the words along in one string, less than half as many bytes as a list of strings.
    words = docs.select(F.col("doc_id").alias("id"), F.array_join(tx.word_tokens(F.col("text")), " ").alias("words"))
    a, b = words.toDF("id1", "w1"), words.toDF("id2", "w2")
    w1, w2 = (F.when(F.col(w) == "", F.array().cast("array<string>")).otherwise(F.split(w, " ")) for w in ("w1", "w2"))
    scored = found.join(a, "id1").join(b, "id2").select("id1", "id2", score(w1, w2).alias("sim"))
    return scored.where(F.col("sim") >= (threshold if keep is None else keep))
