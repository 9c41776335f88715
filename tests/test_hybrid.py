"""The fused score over all pairs of small texts, at thresholds above and below the single bound."""

import math
import random
from collections import Counter

import pytest

from lexiloom.operators import pairs as pr


def scores(texts):
    tf = {i: Counter(t.split()) for i, t in texts}
    n = len(tf)
    df = Counter(t for c in tf.values() for t in c)
    avg = sum(sum(c.values()) for c in tf.values()) / n
    w = {i: {t: (math.log((1 + n) / (1 + df[t])) + 1) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for t, k in c.items()} for i, c in tf.items()}
    out = {}
    for i in tf:
        for j in tf:
            if i < j:
                dot = sum(v * w[j].get(t, 0) for t, v in w[i].items())
                bm = round(min(dot / math.sqrt(sum(v * v for v in w[i].values()) * sum(v * v for v in w[j].values())), 1), 6)
                p, q = ({t: k / sum(c.values()) for t, k in c.items()} for c in (tf[i], tf[j]))
                js = round(min(sum(0.5 * (p[t] * math.log2((p[t] + q[t]) / p[t]) + q[t] * math.log2((p[t] + q[t]) / q[t])) for t in p if t in q), 1), 6)
                high, low = max(bm, js), min(bm, js)
                out[i, j] = round(min((bm + js) / 2 * 1.1, 1) if high - low <= 0.15 else (high * 0.7 + low * 0.3) * 0.85, 6)
    return out


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.62, 0.8, 0.95])
def test_hybrid_finds_every_pair(spark, threshold):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    texts = [(i, " ".join(sorted(rnd.choice(words) for _ in range(rnd.randint(2, 9))))) for i in range(25)]
    seen, rows = set(), []
    for i, t in texts:
        if t not in seen:
            seen.add(t)
            rows.append((i, t))
    found = pr.hybrid_scores(spark.createDataFrame(rows, "doc_id int, text string"), threshold).collect()
    want = {p: s for p, s in scores(rows).items() if s >= threshold}
    got = {(r["id1"], r["id2"]): r["sim"] for r in found}
    edge = {p for p in want.keys() ^ got.keys() if abs(want.get(p, got.get(p)) - threshold) > 2e-6}
    assert not edge and all(abs(got[p] - want[p]) < 2e-6 for p in want.keys() & got.keys())


def test_bound_is_where_the_fusion_meets_the_threshold():
    for t in (0.4, 0.6, 0.7, 0.8, 0.9, 0.99):
        b = pr.fused_bound(t)
        fused = lambda x, y: min((x + y) / 2 * 1.1, 1) if abs(x - y) <= 0.15 else (max(x, y) * 0.7 + min(x, y) * 0.3) * 0.85
        assert all(fused(x / 1000, y / 1000) < t for x in range(int(b * 1000)) for y in range(0, 1001, 5))
