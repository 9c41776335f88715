"""Operators of the llm package against brute force, round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import bpe, chat, mixing, ngram_join, pii, quality, substring_dedup, topk, toxicity, winnowing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, hub int, key string"


def corpus(n=60, seed=3):
    """Random texts with copies, near copies and a passage of 60 words; then the odd cases."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeghiklmnoprstu") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(60, 200))) for _ in range(n)]
    passage = " ".join(word() for _ in range(60))
    texts[3] = texts[4] = texts[5]
    words = texts[7].split()
    for k in range(8, 14):
        changed = words[:]
        changed[rnd.randrange(len(words))] = word()
        texts[k] = " ".join(changed)
    for k in (20, 21, 22)[: max(0, n - 20)]:
        cut = texts[k].split()
        texts[k] = " ".join(cut[:17] + [passage] + cut[17:])
    return texts + [None, "", " \n\t", "one", "One", "a b c d", "A b\tc d", "x " * 3000, "y" * 20000]


def frame(spark, texts, start=0):
    rows = [(start + i, t, None, f"s{i % 4}" if i % 5 else None, 0, 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def brute_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), Counter()
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if o and 100 * o >= 80 * len(x | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(sets[i]), root[i], links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard_groups_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join.meetings, "__defaults__", (block,))
    texts = corpus()
    got = ngram_join.jaccard_groups(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in got} == brute_groups(texts)


def test_jaccard_groups_of_no_rows_and_repeated_rows(spark):
    empty = frame(spark, ["a"]).where("false")
    assert ngram_join.jaccard_groups(empty).count() == 0
    twice = frame(spark, ["a b c d e f g"])
    got = ngram_join.jaccard_groups(twice.unionByName(twice).unionByName(frame(spark, ["z"]).withColumn("doc_id", F.lit(None).cast("bigint"))))
    rows = sorted(got.collect(), key=lambda r: r["n_shingles"])
    assert [r["component_id"] for r in rows] == [None, 0, 0]


def test_signature_tree_finds_all_pairs():
    rnd = np.random.default_rng(1)
    sets = []
    for _ in range(90):
        base = rnd.integers(0, 1 << 60, rnd.integers(5, 60)).astype(np.uint64)
        for _ in range(rnd.integers(1, 4)):
            keep = base[rnd.random(len(base)) < 0.95]
            if len(keep):
                sets.append(np.unique(keep))
    members = [(k, 1, s, frozenset([0])) for k, s in enumerate(sets)]
    found = {i: n for i, n, _ in ngram_join.compare_meeting(0, members, None)}
    want = Counter()
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                want[i] += 1
                want[j] += 1
    assert found == dict(want)


def test_bpe_equals_the_library_and_round_trips(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(2)
    texts = corpus(20) + ["<|endoftext|>x<|endoftext|>", "'ll don't  \n\n \u00a0é🙂漢字 123", "a" * 3000, "\x00\x85\u2028"]
    texts += ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz éñ'1\n") for _ in range(80)) for _ in range(50)]
    got = bpe.encode_documents(frame(spark, texts), path).select("doc_id", "ids", "decoded", *bpe.digest_columns(F.col("ids"), F.col("decoded"))).collect()
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def plain_winnow(text):
    if not text:
        return []
    grams = winnowing.gram_hashes(np.array([ord(c) for c in text], dtype=np.uint64)).tolist()
    out = set()
    span = min(winnowing.WINDOW, len(grams))
    for k in range(len(grams) - span + 1):
        low = min(grams[k : k + span])
        out.add(max(p for p in range(k, k + span) if grams[p] == low))
    return [(grams[p], p) for p in sorted(out)]


def test_winnowing_is_minimal_and_rightmost():
    for t in ["", "a", "ab" * 100, "x" * 500, *filter(None, corpus(14))]:
        h, p = winnowing.winnow(t[:1500])
        assert list(zip(h.tolist(), p.tolist())) == plain_winnow(t[:1500])
    # Equal grams have equal hashes wherever they stand.
    g = winnowing.gram_hashes(np.array([ord(c) for c in ("abcdefghijklmnopqrstuvwxyz" * 3)], dtype=np.uint64))
    assert g[0] == g[26] == g[52]


def test_fingerprints_follow_descending_ids(spark):
    texts = corpus(30)
    got = {r["doc_id"]: r for r in winnowing.fingerprints(frame(spark, texts)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        t, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        other = winnowing.edited(t, following)
        assert got[i]["edited_sha256"] == hashlib.sha256(other.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[3]["fingerprint"] == got[4]["fingerprint"]
    assert winnowing.fingerprints(frame(spark, ["a"]).where("false")).count() == 0
    assert winnowing.fingerprints(frame(spark, ["lone text"])).count() == 1


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_meets_targets(spark):
    texts = corpus() + ["tiny words here"]
    docs = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") == len(texts) - 1, "a-tiny").when(F.col("doc_id") < 30, "hot").otherwise(F.col("source")))
    rows = mixing.taken_words(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert len(rows) == len(texts)
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted(again) == sorted(rows)
    assert mixing.taken_words(docs.where("false")).count() == 0


def test_chat_parts_become_placeholders_and_come_back(spark):
    rows = [
        (1, 0, "user", [("text", "see \\l <turn> ", None, None), ("image", None, "a.png", None), ("text", "\\b</turn>", None, None), ("audio", None, "b.wav", 9)]),
        (1, 1, "assistant", [("text", "first\\", None, None)]),
        (1, 2, "assistant", [("text", "<say>", None, None)]),
        (2, 0, None, None),
    ]
    got = {r["conv_id"]: r for r in chat.format_messages(spark.createDataFrame(rows, f"conv_id bigint, turn int, role string, parts array<{chat.PART}>")).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_masked(F.col("formatted"), F.col("loss_spans")).alias("masked")).collect()}
    assert [t["content"] for t in got[1]["turns"]] == ["see \\l <turn> <image:1>\\b</turn><audio:2>", "first\\", "<say>"]
    assert got[1]["masked"] == "first\\<say>" and got[2]["turns"][0]["content"] == ""
    assert [(a["part"]["ref"], a["part"]["tokens"]) for a in got[1]["attachments"]] == [("a.png", 576), ("b.wav", 9)]
    assert got[1]["n_tokens_attached"] == 585


def test_repeated_passages_are_found(spark):
    texts = corpus()
    rows = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    found = {r["doc_id"] for r in rows}
    assert {3, 4, 5, 20, 21, 22} <= found and not found & set(range(24, 60))
    near = [r for r in rows if r["kind"] == "paragraph" and 7 <= r["doc_id"] < 14]
    linked = {i for i, (_, root, _) in brute_groups(texts).items() if root == 7}
    assert {r["doc_id"] for r in near} >= linked and sum(not r["removed"] for r in near) == 1
    assert substring_dedup.repeated_passages(frame(spark, ["a"]).where("false")).count() == 0


def brute_topk(rows, k):
    grid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            grid[i] = [int(np.floor(256 * float(x))) for x in v]
    out = []
    for q, a in grid.items():
        if q % 3 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in grid.items() if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_is_exact_with_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rnd.normal(size=40))]) for i in range(200)]
    rows += [(i, rows[5][1]) for i in range(200, 220)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 40), (303, [1e30] * 40), (None, rows[0][1]), (306, [1.0, 2.0]), (309, [0.5, 1.0])]
    df = spark.createDataFrame(rows + rows[:5], "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    kept = [r for r in rows if r[0] != 303]
    got = topk.top_k(df.where("vec_id IS NULL OR vec_id <> 303"), F.col("vec_id") % 3 == 0, 5, block=50).collect()
    assert sorted(map(tuple, got)) == brute_topk(kept, 5)
    assert topk.top_k(df, F.col("vec_id") % 3 == 0).count() > 0 and topk.top_k(df.where("false"), F.lit(True)).count() == 0


def labelled(spark, n=300):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 120))]
        good, toxic = rnd.random() < 0.7, rnd.random() < 0.3
        if toxic:
            words[3:3] = rnd.sample(["idiot", "moron", "stupid", "scum", "pathetic"], 2)
        docs.append(" ".join(words) if good else " ".join(w.upper() + "%%%" for w in words))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (0, labels[0][1], labels[0][2]), (10**6, 0, 1)]
    return docs, frame(spark, docs + [None, "", "  "]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    texts, docs, labels, rows = labelled(spark)
    truth = {i: (q, t) for i, q, t in rows if i is not None and i < len(texts)}
    train = labels.where("doc_id IS NULL OR doc_id < 200")
    kept = {r["doc_id"] for r in quality.selected(docs, train).collect()}
    held = range(200, len(texts))
    assert sum((i in kept) == (truth[i][0] == 1) for i in held) >= 0.97 * len(held)
    flagged = {r["doc_id"] for r in toxicity.toxic_documents(docs, train).collect()}
    assert sum((i in flagged) == (truth[i][1] == 1) for i in held) >= 0.95 * len(held)
    assert not kept & {len(texts), len(texts) + 1, len(texts) + 2}
    assert quality.selected(docs.where("false"), train).count() == 0
    assert toxicity.toxic_documents(docs, labels.where("false")).count() == 0
    assert quality.selected(docs, labels.where("false")).count() == len(texts)  # all but those without words


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for n, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = [int(c) for c in m[0] if c.isdigit() and c.isascii()]
            luhn = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_personal_data_base_matches_brute_force(spark):
    texts = [
        "a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255", "+1 (234) 567-8901..9 ++49 30 1234567", "4111 1111 1111 1111 4111-1111-1111-1112",
        "a" * 3000 + "@b." + "c." * 2000 + "d", "x" * 50000, "1 " * 20000, "1." * 4000, "+1(" + "(" * 20000, None, "", "é🙂 joe@ex.org 🙂 10.0.0.1", "%%%a@b-.c--@d.e", "bob (at) ex (dot) org 555-123-4567",
    ]
    texts += [f"call +1 ({k}23) 555-{k}123 or me.{k}@mail.org from 10.0.{k}.7" for k in range(1, 9)]
    docs = frame(spark, texts)
    rows = pii.personal_data(docs).select("doc_id", "pii_base", "pii_spans", pii.redact(F.col("text"), F.col("pii_spans")).alias("clean"), pii.listed(F.col("pii_base")).alias("listed")).collect()
    for r in rows:
        base = [tuple(s) for s in r["pii_base"]]
        assert base == brute_pii(texts[r["doc_id"]]) and set(base) <= {tuple(s) for s in r["pii_spans"]}
    clean = {r["doc_id"]: r["clean"] for r in rows}
    assert clean[11] == "é🙂 [EMAIL] 🙂 [IP]" and clean[9] is None
    assert {r["listed"] for r in rows if r["doc_id"] == 11} == {"email:3:13,ip:16:24"}
    assert pii.personal_data(docs.where("false")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    texts, docs, labels, rows = labelled(spark)
    more = frame(spark, [texts[0]] * 3 + ["mail joe@ex.org " + " ".join(f"w{k}" for k in range(30))], 1000)
    docs.unionByName(more).drop("hub", "key").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), None
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = kept.columns
        after = stage(spark, kept, str(tmp_path)).cache()
        assert after.columns == columns
        if name == "ngram_jaccard_join":
            same = defaultdict(list)
            for r in after.collect():
                same[r["text"]].append(r["doc_id"])
            assert all(len(v) == 1 for v in same.values())
        if name == "personal_data":
            assert after.where("text LIKE '%@%'").count() == 0 and after.count() == kept.count()
        kept = after
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == kept.count()
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in kept.collect())
