"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features and ordered thresholds: P(grade <= k) = s(t_k - w.x).
It gives the expected grade and the tail probabilities P(grade >= k) that select documents.

Fitting takes a bounded sample: the ``max_train`` labelled documents with the smallest hash of their
id. Scoring covers every document, whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexiloom.llm.names import free_name
from lexiloom.llm import shingles as sh

MAX_TRAIN = 6000
BITS = 16
GRADES = 3
_MEMO: dict[bytes, tuple[int, int]] = {}
SLICE_TEXTS = 512
_LETTERS, _UPPER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+")


def _slots(word: bytes) -> tuple[int, int]:
    """The feature of a word and the feature of its shape (runs of letters and digits folded)."""
    known = _MEMO.get(word)
    if known is None:
        shape = re.sub(rb"[0-9]+", b"0", _UPPER.sub(b"A", _LETTERS.sub(b"a", word)))[:16]
        mask = (1 << BITS) - 1
        known = xxhash.xxh3_64_intdigest(b"w" + word.lower()) & mask, xxhash.xxh3_64_intdigest(b"s" + shape) & mask
        if len(_MEMO) >= 200_000:
            _MEMO.clear()
        _MEMO[word] = known
    return known


def forget_words() -> None:
    _MEMO.clear()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): root shares of words, shapes and repeated words; empty for no words."""
    tokens = text.encode("utf-8").split() if text else []
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    counts: dict[int, float] = {}
    n = len(tokens)
    for word, k in Counter(tokens).items():
        a, b = _slots(word)
        counts[a] = counts.get(a, 0) + 0.25 * k
        counts[b] = counts.get(b, 0) + k
    repeats = sum(x == y for x, y in zip(tokens, tokens[1:]))
    marks = {b"r": repeats, b"d": n - len(set(tokens)) if n >= 50 else 0}
    for mark, k in marks.items():
        if k:
            slot = xxhash.xxh3_64_intdigest(mark) & ((1 << BITS) - 1)
            counts[slot] = counts.get(slot, 0) + k
    slots = np.fromiter(counts, np.int32, len(counts))
    return slots, np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / n).astype(np.float32)


@dataclass
class Ordinal:
    """Shared weights, ascending thresholds, and the tail probability from which documents stay."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.0

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by row."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _scores(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    return np.array([float(weights[s] @ v) for s, v in rows])


def fit_ordinal(rows, grades: np.ndarray, rounds: int = 200, rate: float = 0.5, ridge: float = 1e-5) -> Ordinal:
    """Maximum likelihood with a small ridge by full-batch Adam; thresholds stay ordered as a first
    value plus positive steps. Grades count half by frequency, so rare grades are not drowned."""
    n = len(rows)
    slots = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows]).astype(np.float64)
    at = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    steps = GRADES - 1
    w, t = np.zeros(1 << BITS), np.array([-1.0, *[0.0] * (steps - 1)])
    share = np.bincount(grades, minlength=GRADES) / n
    weight = (1 / np.sqrt(np.maximum(share, 1e-9)))[grades]
    weight /= weight.sum()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for r in range(1, rounds + 1):
        theta = np.cumsum(np.r_[t[0], np.exp(t[1:])])
        score = np.bincount(at, w[slots] * values, n)
        below = np.c_[np.zeros(n), 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40))), np.ones(n)]
        slope = below * (1 - below)
        i = np.arange(n)
        p = np.maximum(below[i, grades + 1] - below[i, grades], 1e-12)
        up, down = slope[i, grades + 1] / p * weight, slope[i, grades] / p * weight
        g_theta = np.array([-(up[grades == k].sum()) + down[grades == k + 1].sum() for k in range(steps)])
        g_w = np.bincount(slots, ((up - down)[at]) * values, 1 << BITS) + ridge * w
        g_t = np.array([g_theta[k:].sum() * (1 if k == 0 else np.exp(t[k])) for k in range(steps)])
        for x, g, a, b in ((w, g_w, moments[0], moments[1]), (t, g_t, moments[2], moments[3])):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-9)
    return Ordinal(w, np.cumsum(np.r_[t[0], np.exp(t[1:])]))


def sample_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> list:
    """(doc_id, label columns, slots, values) of the bounded sample, in order of doc_id."""
    picked = labels.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    marks = [c for c in picked.columns if c != "doc_id"]

    def build(batches):
        for pdf in batches:
            made = [features(t) for t in pdf["text"]]
            out = pdf[["doc_id", *marks]].copy()
            out["slots"] = pd.Series([s.tobytes() for s, _ in made], dtype=object, index=out.index)
            out["values"] = pd.Series([v.tobytes() for _, v in made], dtype=object, index=out.index)
            yield out

    schema = "doc_id bigint, " + ", ".join(f"{c} int" for c in marks) + ", slots binary, values binary"
    seen = {r["doc_id"]: r for r in texts.mapInPandas(build, schema).collect()}
    return [seen[k] for k in sorted(seen)]


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of the label table: 0 for low quality, 1 for good but toxic texts, 2 for good ones."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", grade.alias("grade"))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Ordinal | None:
    """The model, with a cut chosen on every fifth sampled row, which a first fit has not seen.

    The cut lies midway between the tail probabilities of the two best separating neighbours, at most
    at an even chance. None
    if the sample does not hold both accepted and rejected documents.
    """
    rows = sample_rows(docs, graded(labels), max_train)
    data = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
    grades = np.array([r["grade"] for r in rows], dtype=np.int64)
    held = np.arange(len(rows)) % 5 == 4
    if min((grades[~held] > 0).sum(), (grades[~held] == 0).sum(), (grades[held] > 0).sum(), (grades[held] == 0).sum()) == 0:
        return None
    first = fit_ordinal([d for d, h in zip(data, held) if not h], grades[~held])
    tail = first.tails(_scores([d for d, h in zip(data, held) if h], first.weights))[:, 0]
    good = grades[held] > 0
    order = np.argsort(tail)
    values, kept = tail[order], good[order]
    lost = np.cumsum(np.r_[0, kept]) / kept.sum()
    passed = 1 - np.cumsum(np.r_[0, ~kept]) / (~kept).sum()
    k = int(np.argmin(lost + passed))
    edges = np.r_[0.0, values, 1.0]
    model = fit_ordinal(data, grades)
    model.cut = min(0.5, float((edges[k] + edges[k + 1]) / 2))
    return model


SCORE = StructType([StructField(c, DoubleType()) for c in ("expected_grade", "p_usable", "p_good")])


def score_column(spark, model: Ordinal | None):
    """A function from a text column to (expected_grade, p_usable, p_good).

    The model has a fixed size. A text without words scores 0; without a model all texts score as good.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCORE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            parts = [np.zeros((0, GRADES - 1))]
            for at in range(0, len(texts), SLICE_TEXTS):
                made = [features(t) for t in texts.iloc[at : at + SLICE_TEXTS]]
                tails = np.ones((len(made), GRADES - 1)) if m is None else m.tails(_scores(made, m.weights))
                tails[[not len(s) for s, _ in made]] = 0.0
                parts.append(tails)
            tails = np.concatenate(parts)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_usable": tails[:, 0], "p_good": tails[:, 1]})
        # Workers are used again by later stages, which need the memory.
        forget_words()

    return score


def selected(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that pass, with their scores in a last struct column ``quality_score``, or the
    first free name after it where ``docs`` has such a column.

    Null, empty and blank texts are rejected; repeated rows share their fate; labels that are null or
    of unknown documents are left out; an empty table gives an empty result.
    """
    model = train(docs, labels, max_train)
    cut = model.cut if model else 0.5
    name = free_name(docs, "quality_score")
    # Not deterministic for the optimizer, so that filter and result share one run of the model.
    score = score_column(docs.sparkSession, model).asNondeterministic()
    scored = docs.select(*docs.columns, score("text").alias(name))
    return scored.where(F.col(name)["p_usable"] >= cut)
