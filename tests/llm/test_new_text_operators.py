"""Fill-in-the-middle, suffix-array dedup and collocations against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import collocations as co, fill_in_middle as fim, suffix_dedup as sd

DOCS = "doc_id bigint, text string, lang string, n string, output int, v int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "r") for i, t, lang in rows], DOCS)


TEXTS = [
    None, "", "\n", "a", "é\nб\n\n😀x", "one\ntwo\nthree", "ends\n", "holds <M> mark\nand more", "<\nS>\n<P", "日本\n" * 40 + "語",
    "plain ascii\n" * 500, "x" * 50_000 + "é" * 50_000, "a\r\nb\r\n", "ab<\nS><S\n",
]


def brute_fim(doc_id, text, unit):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    g = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return (len(u), "plain", None, None, t)
    x, y = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:x]), "".join(u[x:y]), "".join(u[y:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return (len(u), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle_matches_plain_cuts(spark, unit):
    rows = [(i, t, None) for i in range(12) for t in TEXTS] + [(None, "null\nid", None), (3, "again\nrow", None), (3, "again\nrow", None)]
    made = fim.fill_in_middle(frame(spark, rows), unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *brute_fim(i, t, unit), t or "") for i, t, _ in rows)
    assert Counter(tuple(r) for r in made) == want
    assert {"psm", "spm", "plain"} == {r["form"] for r in made}


def test_fill_in_middle_of_no_rows_and_rates(spark):
    assert fim.fill_in_middle(frame(spark, [])).collect() == []
    assert {r["form"] for r in fim.fill_in_middle(frame(spark, [(i, "a\nb", None) for i in range(20)]), fim_percent=0).collect()} == {"plain"}


def test_exception_index_converts_both_ways():
    text = "aé😀b日\nz"
    index = fim.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    cuts = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.to_points(cuts).tolist() == list(range(len(text) + 1))
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == cuts.tolist()
    assert len(index.at) == 3


def brute_repeats(rows, size, keep_first):
    places = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda k: ((1 << 63) - 1 if rows[k][0] is None else rows[k][0], hashlib.sha256((rows[k][1] or "").encode()).digest()[:16]))
    for k in order:
        b = (rows[k][1] or "").encode()
        for p in range(len(b) - size + 1):
            places[b[p : p + size]].append((k, p))
    marks = [bytearray(len((t or "").encode())) for _, t, *_ in rows]
    for found in places.values():
        for k, p in found[1 if keep_first else 0 :] if len(found) > 1 else []:
            marks[k][p : p + size] = b"\1" * size
    out = []
    for (i, t, *_), m in zip(rows, marks):
        b = (t or "").encode()
        spans = sum(1 for q in range(len(m)) if m[q] and (q == 0 or not m[q - 1]))
        out.append((i, len(b), sum(m), spans, bytes(c for c, x in zip(b, m) if not x)))
    return Counter(out)


def repeat_rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéñ日") for _ in range(rnd.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    base, passage = say(120), say(15)
    texts = [say(60) for _ in range(10)] + [base] * 3
    for _ in range(14):
        changed = base.split()
        changed[rnd.randrange(len(changed))] = word()
        texts.append(" ".join(changed))
    texts += [say(20) + passage + say(20) for _ in range(5)] + [passage + passage + passage, "z" * 3000, "ab" * 900 + "!" + "ab" * 40, None, "", "short", passage[:30]]
    return [(i, t, None) for i, t in enumerate(texts)] + [(None, base, None), (None, say(5) + passage, None)]


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("hot_runs", [1 << 12, 2])
def test_repeats_match_brute_force(spark, keep_first, hot_runs, monkeypatch):
    rows = repeat_rows()
    found = sd.without_repeats(frame(spark, rows), 50, keep_first, hot_runs).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found)
    assert got == brute_repeats(rows, 50, keep_first)


def test_repeated_rows_all_go_and_no_rows_stay_none(spark):
    rows = [(1, "q" * 10 + "w" * 60, None), (1, "q" * 10 + "w" * 60, None)]
    assert [r["n_removed"] for r in sd.without_repeats(frame(spark, rows), 50, False).collect()] == [70, 70]
    assert sd.without_repeats(frame(spark, []), 50, False).collect() == []


def test_windows_meet_over_piece_edges():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 105, 3000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    whole = list(sd.window_runs(data, 200))
    assert sum(r[1] for r in whole) == len(data) - 199
    covered = sorted(p + k for p, m, *_ in whole for k in range(m))
    assert covered == list(range(len(data) - 199))
    hash_of = {p + k: v for p, m, v, _ in whole for k in range(m)}
    assert all(hash_of[100 + k] == hash_of[2000 + k] for k in range(201))


def test_suffix_ranks_order_and_equal():
    data = b"banana" + b"anab" + b"nana"
    starts, sizes = np.array([0, 6, 10]), np.array([6, 4, 4])
    at, rank = sd.suffix_ranks(np.frombuffer(data, np.uint8), starts, sizes, 3)
    prefixes = [data[p : p + 3] for p in at.tolist()]
    for x, r in zip(prefixes, rank):
        for y, s in zip(prefixes, rank):
            assert (x < y) == (r < s) and (x == y) == (r == s)
    first = sd.factor_matches(at, rank)
    assert [bool(f) for f in first] == [p in prefixes[:k] for k, p in enumerate(prefixes)]


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows_of = defaultdict(list)
    for (lang, w), a in cands.items():
        if any(l2 == lang and len(o) > len(w) and any(o[i : i + len(w)] == w for i in range(len(o))) and 100 * b >= 50 * a for (l2, o), b in cands.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows_of[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in rows_of.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("budget,slice_words,bits", [(1 << 22, 1 << 20, 16), (40, 200, 16), (8, 50, 2)])
def test_collocations_match_brute_force(spark, budget, slice_words, bits, monkeypatch):
    rnd = random.Random(2)
    vocab = ["New", "york", "é", "日本", "of", "the", "city", "x<P>", "a-b"]
    say = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", "\x0b"]) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 80)), rnd.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(1, "hot pair " * 400, "en"), (2, None, "en"), (3, "", None), (4, " \t\n", "fr"), (None, "New york city " * 30, "en")] + [(5, "same row here", "en")] * 30
    monkeypatch.setattr(co, "LEAST_BUDGET", 1)
    monkeypatch.setattr(co, "SLICE_WORDS", slice_words)
    found = co.collocations(frame(spark, rows), 10, 50, 25, budget).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, 10, 25)


def test_collocations_of_no_rows(spark):
    assert co.collocations(frame(spark, [])).collect() == []


def test_layout_splits_hot_slots():
    one = np.zeros(co.SLOTS, np.int64)
    one[[1, 2, 3]] = 5, 100, 6
    layout = co.Layout(one, 10)
    two = np.zeros(co.SLOTS, np.int64)
    two[[7, 8]] = 35, 4
    layout.refine(two)
    assert layout.split_one[2] and not layout.split_one[1] and layout.split_two[7] and layout.pieces[7] == 4
    assert layout.group_one[1] != layout.group_one[3] and layout.group_two[8] not in range(int(layout.group_two[7]), int(layout.group_two[7]) + 4)
