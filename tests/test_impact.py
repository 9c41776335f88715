"""Pruned best pairs against all pairs."""

import math
import random

import pytest

from lexiloom.operators import impact as im


def rows_of(vectors):
    return [(i, t, w) for i, v in vectors.items() for t, w in v.items()]


def brute(left, right):
    out = {}
    for i, a in left.items():
        for j, b in right.items():
            common = a.keys() & b.keys()
            if common:
                dot = sum(a[t] * b[t] for t in common)
                out[i, j] = round(min(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 1.0), 6)
    return out


@pytest.mark.parametrize("most,k,threshold", [(64, 10, 0.4), (2, 3, 0.9), (1, 3, 0.2), (3, 50, 0.3)])
def test_keeps_what_counts(spark, monkeypatch, most, k, threshold):
    monkeypatch.setattr(im.champions, "__defaults__", (most,))
    rnd = random.Random(most)
    common = [f"c{n}" for n in range(4)]

    def vector():
        v = {t: rnd.uniform(0.05, 0.4) for t in common if rnd.random() < 0.9}
        return v | {f"r{rnd.randrange(40)}": rnd.uniform(0.5, 2) for _ in range(rnd.randint(0, 5))}

    left = {f"a{i}": vector() for i in range(12)}
    right = {f"b{i}": vector() for i in range(120)}
    left["a_none"] = {"nowhere": 1.0}
    shape = "id string, term string, w double"
    found = im.best_pairs(spark.createDataFrame(rows_of(left), shape), spark.createDataFrame(rows_of(right), shape), k, threshold).collect()
    got, every = {(r["lid"], r["rid"]): r["sim"] for r in found}, brute(left, right)
    assert all(abs(s - every[p]) < 2e-6 for p, s in got.items())
    for i in left:
        own = sorted((s for (a, _), s in every.items() if a == i), reverse=True)
        kth = own[k - 1] if len(own) >= k else 0.0
        need = {p for p, s in every.items() if p[0] == i and (s >= threshold or s >= kth)}
        assert need <= got.keys() | {p for p in need if every[p] in (kth, threshold)}
    if most == 64 and threshold == 0.4:
        assert len(got) < len(every)
