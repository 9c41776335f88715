"""Segmenters against plain loops over sentences, and literal cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import segments as sg

SIZES = {"low": 30, "high": 160, "target": 60}


def sentences(text):
    out, at = [], 0
    for piece in re.findall(r"[^.!?\n]*(?:[.!?]+|\n)|[^.!?\n]+", text):
        at += len(piece)
        if piece.strip(" \t\n\r"):
            out.append((piece.strip(" \t\n\r"), at - len(piece), at))
    return out


def divergence(sents, w):
    if len(sents) < w:
        wins = [sents]
    else:
        wins = [sents[k : k + w] for k in range(len(sents) - w + 1)]
    counts = []
    for win in wins:
        c = {}
        for t in re.findall(r"[a-z0-9_\-]{2,}", " ".join(x[0] for x in win).lower()):
            c[t] = c.get(t, 0) + 1
        counts.append(c)
    df = {t: sum(t in c for c in counts) for c in counts for t in c}
    vec = [{t: (1 + math.log(n)) * (math.log((1 + len(wins)) / (1 + df[t])) + 1) for t, n in c.items()} for c in counts]
    out = []
    for a, b, win in zip(vec, vec[1:], wins):
        x, y = sum(v * v for v in a.values()), sum(v * v for v in b.values())
        dot = sum(v * b.get(t, 0) for t, v in a.items())
        out.append((round(0.0 if not x and not y else 1.0 if not x or not y else 1 - min(dot / math.sqrt(x * y), 1), 6), win[-1][2]))
    return out


def maxima(vals, t):
    n = len(vals)
    if n < 3:
        return [i for i in range(n) if vals[i] >= t]
    s = [round(sum(vals[max(i - 1, 0) : i + 2]) / len(vals[max(i - 1, 0) : i + 2]), 9) for i in range(n)]
    need, out = round(0.2 * (max(s) - min(s)), 9), []
    for i in range(n):
        if s[i] < t or (i and s[i - 1] > s[i]) or (i < n - 1 and s[i + 1] > s[i]):
            continue
        left = max((j for j in range(i) if s[j] > s[i]), default=-1)
        right = min((j for j in range(i + 1, n) if s[j] > s[i]), default=n)
        base = max(([min(s[left + 1 : i + 1])] if i else []) + ([min(s[i:right])] if i < n - 1 else []))
        if round(s[i] - base, 9) >= need:
            out.append(i)
    return out


def nearest(ends, goal):
    return min(ends, key=lambda e: (abs(e - goal), e), default=-1)


def force(last, stop, ends, high, hard):
    out = []
    while stop - last > high:
        near = nearest(ends, last + high)
        if last < near < stop:
            last = near
        elif hard:
            last += high
        else:
            break
        out.append(last)
    return out


def few(ends, n, low, high, target):
    if n <= high:
        return []
    cuts, start = [], 0
    for e in ends:
        if e - start >= target:
            cuts.append(e)
            start = e
    return cuts[:-1] if cuts and 0 < n - start < low else cuts


def fit(wanted, ends, n, low, high, target):
    cuts, last = [], 0
    for pos in sorted(wanted):
        cuts += force(last, pos, ends, high, True)
        last = cuts[-1] if cuts else last
        if pos - last >= low and (pos - last >= target or pos - last > high * 0.8):
            cuts.append(pos)
            last = pos
    return cuts + force(last, n, ends, high, True)


def spans(cuts, n):
    edges = [0, *sorted({c for c in cuts if 0 < c < n}), n]
    return list(zip(edges, edges[1:]))


def plain(text, kind, w, low, high, target):
    n, sents = len(text), sentences(text)
    ends = [e for *_, e in sents]
    if not text.strip(" \t\n\r"):
        return []
    if n <= low:
        return [(0, n)]
    if len(sents) < w + 1:
        return spans(few(ends, n, low, high, target), n)
    series = divergence(sents, w)
    vals = [v for v, _ in series]
    if kind == "divergence":
        return spans(fit([series[i][1] for i in maxima(vals, 0.42)], ends, n, low, high, target), n)
    order = sorted(vals, reverse=True)
    t = max(order[max(math.floor(len(order) * 0.2 - 1), 0)], 0.13)
    kept, last = [], 0
    for pos in sorted(series[i][1] for i in maxima(vals, t)):
        if pos - last >= low:
            kept.append(pos)
            last = pos
    out, last = [], 0
    for pos in [*kept, n]:
        if pos - last > high:
            own, at = [x for x in sents if x[1] >= last and x[2] <= pos], last
            half, cuts = max(w // 2, 1), []
            if len(own) > half:
                sub = divergence(own, half)
                order = sorted((v for v, _ in sub), reverse=True)
                for c in sorted(sub[i][1] for i in maxima([v for v, _ in sub], max(order[len(order) // 2], 0.13))) if sub else []:
                    if last < c < pos and c - at >= low and pos - c >= low:
                        cuts.append(c)
                        at = c
            out += cuts + force(cuts[-1] if cuts else last, pos, ends, high, False)
        if pos < n:
            out.append(pos)
        last = pos
    return spans(out, n)


def texts():
    rnd = random.Random(9)
    topics = [[f"{t}{k}" for k in range(6)] for t in ("alpha", "beta", "gamma")]
    out = []
    for _ in range(25):
        parts = []
        for _ in range(rnd.randint(1, 14)):
            words = rnd.choice(topics)
            parts.append(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9))) + rnd.choice([". ", "! ", "\n", ".\n\n"]))
        out.append("".join(parts))
    return out + ["", " \n ", "short.", "x" * 500, "a. " * 3 + "y" * 400 + ". b.", "no stop at all " * 20, "one. two. three. " + "z" * 200 + ". four. five."]


@pytest.mark.parametrize("kind,window", [("divergence", 3), ("divergence", 2), ("adaptive", 3), ("adaptive", 4)])
def test_segments_equal_plain_loops(spark, kind, window):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = {}
    for r in sg.segment(docs, kind, window=window, **SIZES).orderBy("id", "seg_no").collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"]))
    for i, t in rows:
        assert got.get(i, []) == plain(t, kind, window, **SIZES), (i, t)


def test_tfidf_cuts_between_topics(spark):
    text = "Red apple fruit here. Apple fruit red again. Fruit of red apple. Stone road north. North road of stone. Stone on north road."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    found = sg.segment(docs, "tfidf", window=2, low=20, high=200, target=40).collect()
    assert [(r["start"], r["end"]) for r in found][-1][1] == len(text)
    bodies = sg.segment_texts(sg.segment(docs, "tfidf", window=2, low=20, high=200, target=40), docs).orderBy("seg_no").collect()
    assert "".join(b["text"] for b in bodies) == text


def test_few_sentences(spark):
    df = spark.range(1)
    cut = lambda ends, n, low, high, target: df.select(sg.few_sentence_cuts(F.array(*map(F.lit, ends)).cast("array<bigint>"), F.lit(n), low, high, target)).first()[0]
    assert cut([50, 55], 55, 10, 40, 40) == []
    assert cut([50, 90, 95], 95, 10, 60, 40) == [50]
    assert cut([100, 200], 250, 10, 100, 80) == [100, 200]
