import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import components as cc, lexical as lx, minhash as mh, pairs as pr, pairwise as pw, trees as tr

TEXTS = [
    "red green blue yellow brown", "red green blue yellow brown", "red green blue yellow black",
    "cat dog bird fish", "cat dog bird fish mouse", "totally different words here", "", "the the the the cat",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def brute(strategy):
    counts = [Counter(t.split()) for t in TEXTS]
    n = len(TEXTS)
    df = Counter(w for c in counts for w in c)
    lens = [sum(c.values()) for c in counts]
    avg = sum(lens) / sum(1 for x in lens if x)

    def weight(i, w):
        idf = math.log((1 + n) / (1 + df[w])) + 1
        k = counts[i][w]
        if strategy == "tfidf":
            return (1 + math.log(k)) * idf
        return idf * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * lens[i] / avg))

    out = {}
    for a, b in combinations(range(n), 2):
        shared = set(counts[a]) & set(counts[b])
        if not shared:
            continue
        if strategy == "jsd":
            p = {w: counts[a][w] / lens[a] for w in counts[a]}
            q = {w: counts[b][w] / lens[b] for w in counts[b]}
            out[a, b] = sum(0.5 * (p[w] * math.log2((p[w] + q[w]) / p[w]) + q[w] * math.log2((p[w] + q[w]) / q[w])) for w in shared)
        else:
            norm = [math.sqrt(sum(weight(i, w) ** 2 for w in counts[i])) for i in (a, b)]
            out[a, b] = sum(weight(a, w) * weight(b, w) for w in shared) / (norm[0] * norm[1])
    return out


@pytest.mark.parametrize("strategy", ["tfidf", "bm25", "jsd"])
@pytest.mark.parametrize("threshold", [0.15, 0.55, 0.9])
def test_joins_match_brute_force(docs, strategy, threshold):
    found = pr.expand_pairs(pr.compare(docs, strategy, threshold), lx.copy_members(docs))
    got = {(r["id1"], r["id2"]): r["sim"] for r in found.collect() if (r["id1"], r["id2"]) != (6, 6)}
    want = {k: v for k, v in brute(strategy).items() if v >= threshold}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_hot_keys_are_split_without_loss(spark):
    rows = spark.range(60).select("id", F.lit("k").alias("key"), F.lit(60).alias("n"))
    met = pr.spread_self_join(rows, ["key"], "n", F.lit(True), hot_rows=7)
    assert met.count() == 60 * 59 // 2


def test_threshold_edges(docs):
    assert pr.compare(docs, "tfidf", 1.5).count() == 0
    with pytest.raises(ValueError):
        pr.compare(docs, "tfidf", 0.0)
    assert pr.small_all_pairs(docs.withColumnRenamed("doc_id", "id")).count() == 28
    with pytest.raises(ValueError):
        pr.small_all_pairs(docs.sparkSession.range(30))


def test_false_discovery_edges(spark, docs):
    pairs = spark.createDataFrame([(1, 2, 0.95), (3, 4, 0.5)], "id1 long, id2 long, sim double")
    counts = pairs.groupBy("sim").agg(F.count(F.lit(1)).alias("pairs"))
    assert pr.false_discovery_filter(pairs, counts, 0.0, F.lit(10.0), 0.5).count() == 0
    assert pr.false_discovery_filter(pairs, counts, 1.0, F.lit(10.0), 0.5).count() == 2
    assert pr.false_discovery_filter(pairs, counts, 0.05, F.lit(10.0), 0.5).count() == 1


def test_pairwise_scores(spark):
    rows = spark.createDataFrame([(1, "aa bb cc", "aa bb cc"), (2, "aa bb", "cc dd"), (3, "", ""), (4, "aa", "")], "id long, a string, b string")
    jsd = {r["id"]: r["jsd"] for r in pw.jsd_distance(rows, "id", "a", "b").collect()}
    assert jsd == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}
    dist = {r["id"]: round(r["dist"], 9) for r in pw.tfidf_distance(rows, "id", "a", "b").collect()}
    assert dist == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}


def test_band_parameters():
    want = {0.25: (42, 3), 0.4: (32, 4), 0.5: (25, 5), 0.7: (16, 8), 0.8: (11, 11), 0.9: (7, 18)}
    assert {t: mh.band_parameters(t) for t in want} == want


def test_minhash_finds_equal_sets(docs):
    sigs, members = mh.signature_groups(mh.signatures(lx.corpus_tf(docs)))
    assert sigs.count() == 6
    assert {r["sim"] for r in mh.scored_pairs(sigs, 0.4).collect()} <= {i / 128 for i in range(129)}


def test_components_and_stars(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (7, 9), (8, 9)], "id1 long, id2 long")
    labels = {r["id"]: r["component"] for r in cc.connected_components(pairs).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 7: 7, 8: 7, 9: 7}
    stars = {r["id"]: r["centre"] for r in cc.greedy_stars(pairs).collect()}
    assert stars == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10, 7: 7, 9: 7, 8: 8}


def test_tree_similarity(spark):
    pages = spark.createDataFrame(
        [(1, "<a><b></b><c></c></a>"), (2, "<a><b></b><d></d></a>"), (3, "<a><b></b><c></c><e></e></a>"), (4, "<x><y></y></x>")], "page_id long, html string"
    )
    found = tr.similar_trees(tr.markup_trees(pages), 0.5)
    got = {(r["id1"], r["id2"]): r["sim"] for r in found.collect()}
    assert got == {(1, 2): 0.666667, (1, 3): 0.75, (2, 3): 0.5}


def test_bounded_tree_distance_is_exact_up_to_its_limit():
    def shape(seed: int):
        rnd = random.Random(seed)
        labels, parents, stack = [], [], []
        for i in range(rnd.randrange(1, 14)):
            while stack and rnd.random() < 0.4:
                stack.pop()
            parents.append(stack[-1] if stack else -1)
            labels.append(rnd.choice("abc"))
            stack.append(i)
        return tr._shape(labels, parents, False)

    for seed in range(0, 400, 2):
        a, b = shape(seed), shape(seed + 1)
        exact = tr.edit_distance(a, b)
        for limit in (0.0, 2.0, 5.0, 9.0):
            found = tr.edit_distance(a, b, limit=limit)
            assert found == exact if exact <= limit else found >= exact


def test_tree_pairs_are_compared_in_many_tasks(spark):
    pages = spark.createDataFrame([(i, "<a>" + "<b></b>" * i + "</a>") for i in range(30, 70)], "page_id long, html string")
    found = tr.similar_trees(tr.markup_trees(pages), 0.9)
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    got = {(r["id1"], r["id2"]): r["sim"] for r in found.collect()}
    assert got == {(i, j): round(1 - (j - i) / (j + 1), 6) for i in range(30, 70) for j in range(i + 1, 70) if j - i <= 0.1 * (j + 1)}
    assert tasks > 1


def test_user_scores_do_not_depend_on_corpus_size(spark):
    from lexiloom.operators import candidates
    from lexiloom.plans.dedup import jaccard_score

    same = ["alpha beta gamma delta epsilon", "beta alpha gamma delta epsilon", "epsilon delta gamma beta alpha"]
    rows = [(i, t) for i, t in enumerate([*same, same[0]])]
    rest = [(100 + i, f"word{i}a word{i}b word{i}c word{i}d") for i in range(204)]
    found = []
    for n in (49, 204):
        docs = spark.createDataFrame(rows + rest[:n], "doc_id bigint, text string")
        found.append(sorted((r["id1"], r["id2"]) for r in candidates.prefiltered_scores(docs, 1.0, jaccard_score(), keep=0.8).collect()))
    assert found[0] == found[1] == [(0, 1), (0, 2), (0, 3), (1, 2)]
