"""Block search and the provider cascade against plain loops."""

import random

from pyspark.sql import functions as F

from lexiloom.operators import blocks as bl, search as se


def brute(items, queries, k, grouped, floor=-10.0):
    out = set()
    for q, qv in queries:
        scored = {}
        for i, v, g in items:
            s = round(sum(v.get(p, 0.0) * w for p, w in qv.items()), 6)
            if s > floor:
                scored.setdefault(g if grouped else None, []).append((-s, i))
        for g, rows in scored.items():
            out |= {(q, i, g, -s, r) for r, (s, i) in enumerate(sorted(rows)[:k], 1)}
    return out


def test_blocks_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(bl, "ITEM_BLOCK", 7)
    monkeypatch.setattr(bl, "QUERY_BLOCK", 3)
    rnd = random.Random(4)
    vector = lambda: {p: rnd.choice([0.5, 1.0, 0.25]) for p in rnd.sample(range(12), rnd.randint(0, 5))}
    items = [(i, vector(), rnd.choice(["x", "y", None])) for i in range(60)]
    queries = [(q, vector()) for q in range(10)]
    shape = "array<int>", "array<double>"
    di = spark.createDataFrame([(i, list(v), list(v.values()), g) for i, v, g in items], f"id bigint, pos {shape[0]}, w {shape[1]}, g string")
    dq = spark.createDataFrame([(q, list(v), list(v.values())) for q, v in queries], f"qid bigint, pos {shape[0]}, w {shape[1]}")
    got = {(r["qid"], r["id"], None, r["score"], r["rank"]) for r in bl.block_topk(di, dq, 4, floor=0.0).collect()}
    assert got == brute(items, queries, 4, False, 0.0)
    got = {tuple(r) for r in bl.block_topk(di, dq, 2, "g").select("qid", "id", "g", "score", "rank").collect()}
    assert got == brute(items, queries, 2, True)
    assert bl.block_topk(di.limit(0), dq, 3).collect() == [] and bl.block_topk(di, dq.limit(0), 3).collect() == []


def test_text_ids_and_zero_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [3.0, 4.0]), ("d", None)], "id string, vec array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0])], "qid bigint, qvec array<double>")
    assert [tuple(r) for r in se.batch_topk(vectors, queries, 3).orderBy("rank").collect()] == [(1, "a", 1.0, 1), (1, "c", 0.6, 2), (1, "b", 0.0, 3)]


def test_cascade_asks_the_next_provider_for_the_rest_only(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid bigint")
    asked = []

    def provider(name, answers):
        def ask(q):
            asked.append((name, sorted(r["qid"] for r in q.collect())))
            return q.where(F.col("qid").isin(answers)).select("qid", (F.col("qid") * 10).alias("id"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))

        return se.Provider(name, spark.range(5), 2, ask)

    hits, stats = se.cascade([provider("first", [2]), provider("second", [3, 2])], queries)
    assert asked == [("first", [1, 2, 3]), ("second", [1, 3])]
    assert {(r["qid"], r["provider"]) for r in hits.collect()} == {(2, "first"), (3, "second")}
    assert {(r["provider"], r["indexed"], r["asked"], r["answered"], r["hits"]) for r in stats.collect()} == {("first", 5, 3, 1, 1), ("second", 5, 2, 1, 1)}


def test_cross_similarity_equals_pairs_scored_one_by_one(spark):
    from lexiloom.functions import text as tx
    from lexiloom.operators import lexical as lx, pairwise as pw

    rnd = random.Random(8)
    say = lambda: " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rnd.randint(0, 9)))
    left, right = [(i, say()) for i in range(6)], [(j, say()) for j in range(7)]
    pairs = spark.createDataFrame([(i * 100 + j, a, b) for i, a in left for j, b in right], "key int, a string, b string")
    want = {(r["key"] // 100, r["key"] % 100): round(r["sim"], 9) for r in pw.bm25_similarity(pairs, "key", "a", "b").collect() if r["sim"] and r["sim"] > 0}

    def counts(rows, key, n):
        df = spark.createDataFrame(rows, f"{key} int, text string")
        return lx.term_counts(df.select(key, tx.word_tokens(F.col("text")).alias("toks")), F.col("toks"), key).withColumnRenamed("n", n)

    got = pw.cross_similarity(counts(left, "lid", "na"), counts(right, "rid", "nb")).collect()
    assert {(r["lid"], r["rid"]): round(r["sim"], 9) for r in got} == want
