import math
import random

import numpy as np
import pytest

from lexiloom.operators import blocks as bl


@pytest.mark.parametrize("block,k,threshold", [(1024, 10, 0.4), (16, 3, 0.9), (7, 50, 0.3)])
def test_block_pairs_hold_what_counts(spark, monkeypatch, block, k, threshold):
    monkeypatch.setattr(bl, "ITEM_BLOCK", block)
    monkeypatch.setattr(bl, "QUERY_BLOCK", 5)
    rnd = random.Random(block)

    def vector():
        v = {f"c{n}": rnd.choice([0.1, 0.2, 0.4]) for n in range(4) if rnd.random() < 0.7}
        return v | {f"r{rnd.randrange(40)}": rnd.choice([0.5, 1.0, 2.0]) for _ in range(rnd.randint(0, 5))}

    left, right = {f"a{i}": vector() for i in range(12)}, {f"b{i}": vector() for i in range(150)}
    left["a_none"] = {"nowhere": 1.0}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    every = {}
    for i, a in left.items():
        for j, b in right.items():
            if a.keys() & b.keys():
                every[i, j] = min(sum(a[t] * b[t] for t in a.keys() & b.keys()) / (norm(a) * norm(b)), 1.0)
    frames = [spark.createDataFrame([(i, t, w) for i, v in side.items() for t, w in v.items()], "id string, term string, w double") for side in (left, right)]
    got = {(r["lid"], r["rid"]): r["sim"] for r in bl.best_pairs(*frames, k, threshold).collect()}
    assert all(abs(s - every[p]) < 1e-6 for p, s in got.items())
    for i in left:
        own = sorted((-round(s, 6), j) for (a, j), s in every.items() if a == i)
        need = {(i, j) for n, (s, j) in enumerate(own) if n < k or -s >= threshold}
        assert need <= got.keys()
        if block == 1024:
            assert need == {p for p in got if p[0] == i}


def test_shared_scores_equal_a_product_at_any_slice(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = (np.where(rnd.random((n, 30)) < 0.3, rnd.random((n, 30)), 0.0) for n in (9, 21))
    packed = [((m != 0).sum(1), np.nonzero(m)[1] * (1 << 40), m[np.nonzero(m)]) for m in (a, b)]
    for slice_size in (1, 13, 1 << 21):
        monkeypatch.setattr(bl, "MEETINGS", slice_size)
        assert np.allclose(bl.shared_scores(*packed), a @ b.T)
