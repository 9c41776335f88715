"""Toxicity by a classifier chain.

Categories are predicted in sequence: each linear model sees the hashed words of a text and the
probabilities of the categories before it. In training those are out-of-fold predictions, so a later
model does not learn from probabilities that an earlier one has fitted to the same rows.

The first category is the given label; the others are weak labels, toxic texts with a seed word.
Fitting takes a bounded sample (``max_train`` labelled documents with the smallest hash of their id);
scoring covers every document and whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

MAX_TRAIN = 6000
BITS = 18
FOLDS = 5
SELECTED = 512
CATEGORIES = ("toxic", "insult", "contempt")
#: Seed words of the weak labels.
SEEDS = {
    "insult": ("clown", "idiot", "loser", "moron", "scum", "trash"),
    "contempt": ("disgusting", "pathetic", "stupid", "worthless"),
}
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed words of a text, in ascending order."""
    found = set(_WORD.findall(text.encode("utf-8").lower())) if text else ()
    return np.unique(np.fromiter(map(slot, found), np.int32, len(found)))


@dataclass
class Linear:
    slots: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    bias: float

    def logit(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return x @ self.weights + earlier @ self.chained + self.bias


@dataclass
class Chain:
    models: list[Linear]
    cut: float


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _dense(rows: list[np.ndarray], slots: np.ndarray) -> np.ndarray:
    column = np.full(1 << BITS, -1, dtype=np.int32)
    column[slots] = np.arange(len(slots))
    out = np.zeros((len(rows), len(slots)), dtype=np.float32)
    for line, row in zip(out, rows):
        c = column[row]
        line[c[c >= 0]] = 1.0
    return out


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, rounds: int = 300, lasso: float = 1e-4) -> Linear:
    """L1 logistic regression by accelerated proximal steps on the words that differ most between
    the classes (signed root of the chi-square statistic) in the rows given."""
    n, positives = len(rows), max(1.0, y.sum())
    all_slots = np.concatenate(rows) if n else np.zeros(0, np.int32)
    of_row = np.repeat(y, [len(r) for r in rows])
    total = np.bincount(all_slots, minlength=1 << BITS).astype(float)
    hits = np.bincount(all_slots, of_row, 1 << BITS)
    expected = total * positives / max(n, 1)
    strength = np.where(total >= 3, np.abs(hits - expected) / np.sqrt(expected + 0.5), 0)
    slots = np.sort(np.argsort(-strength, kind="stable")[:SELECTED]).astype(np.int32)
    x = np.c_[_dense(rows, slots), earlier.astype(np.float32)]
    y = y.astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    bias = float(np.log(positives / max(1.0, n - positives)))
    along = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        along = x.T @ (x @ along)
        top = np.linalg.norm(along)
        along = along / max(top, np.float32(1e-12))
    step = np.float32(4.0 / (1.1 * top / max(n, 1) + 1.0))
    t = 1.0
    for _ in range(rounds):
        error = _sigmoid(x @ v + np.float32(bias)) - y
        new = v - step * (error @ x) / np.float32(n)
        new = np.sign(new) * np.maximum(np.abs(new) - step * np.float32(lasso), 0)
        bias -= float(step * error.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + np.float32((t - 1) / t2) * (new - w), new, t2
    k = len(slots)
    return Linear(slots, w[:k].astype(np.float64), w[k:].astype(np.float64), bias)


def _predict(model: Linear, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
    return _sigmoid(model.logit(_dense(rows, model.slots), earlier))


def train_chain(rows: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> Chain:
    """Models in the order of the columns of ``targets``, and the cut of the first category that
    gives the best F1 on its out-of-fold predictions."""
    n = len(rows)
    earlier = np.zeros((n, 0))
    models = []
    for c in range(targets.shape[1]):
        y = targets[:, c].astype(float)
        held = np.zeros(n)
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            if len(inside) and len(outside):
                m = fit_linear([rows[i] for i in outside], earlier[outside], y[outside])
                held[inside] = _predict(m, [rows[i] for i in inside], earlier[inside])
        models.append(fit_linear(rows, earlier, y))
        earlier = np.c_[earlier, held]
    order = np.argsort(-earlier[:, 0], kind="stable")
    p, y = earlier[order, 0], targets[order, 0]
    f1 = 2 * np.cumsum(y) / (np.arange(1, n + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    below = p[k + 1] if k + 1 < n else 0.0
    return Chain(models, float((p[k] + below) / 2))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Chain | None:
    """None if the sample does not hold both kinds of documents."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def build(batches):
        for pdf in batches:
            made = [features(t).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "slots": pd.Series(made, dtype=object, index=pdf.index)})

    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    seen = {r["doc_id"]: r for r in texts.mapInPandas(build, "doc_id bigint, toxic int, slots binary").collect()}
    ids = sorted(seen)
    rows = [np.frombuffer(seen[k]["slots"], np.int32) for k in ids]
    toxic = np.array([seen[k]["toxic"] for k in ids]) == 1
    if not len(ids) or toxic.all() or not toxic.any():
        return None
    seeded = [np.array([np.isin(r, [slot(w.encode()) for w in SEEDS[c]]).any() for r in rows]) & toxic for c in CATEGORIES[1:]]
    folds = np.array([xxhash.xxh3_64_intdigest(str(k)) % FOLDS for k in ids])
    return train_chain(rows, np.c_[toxic, np.array(seeded).T], folds)


def scored(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, toxic, insult, contempt, flagged) for each row; texts without words score by bias."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches):
        chain = shared.value
        for pdf in batches:
            rows = [features(t) for t in pdf["text"]]
            known = np.zeros((len(rows), 0))
            for at, _ in enumerate(CATEGORIES):
                p = _predict(chain.models[at], rows, known) if chain else np.zeros(len(rows))
                known = np.c_[known, p]
            out = pd.DataFrame(known, columns=list(CATEGORIES))
            out.insert(0, "doc_id", pdf["doc_id"].array)
            out["flagged"] = out["toxic"] >= (chain.cut if chain else 2.0)
            yield out

    return docs.select("doc_id", "text").mapInPandas(
        score, "doc_id bigint, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", flagged boolean"
    )


def toxic_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, toxic, insult, contempt): the documents flagged as toxic, with their probabilities.

    Null and empty texts are never flagged, as they hold no word; repeated rows are flagged alike;
    without both kinds of labels nothing is flagged; extra columns are ignored.
    """
    return scored(docs.where("length(text) > 0"), train(docs, labels, max_train)).where("flagged").drop("flagged")
