"""The window series of whole texts and of sentence rows equal the one over window rows."""

import random

from lexiloom.operators import segments as sg


def corpus(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "x", "Été", "7", "ab-c"]
    texts = [None, "", " \n ", "One.", "alpha beta.  \n gamma. delta"]
    texts += ["".join(rng.choice([" ", ". ", "!\n", "  "]) + rng.choice(words) for _ in range(rng.choice([8, 30, 120]))) for _ in range(25)]
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)


def test_series_agree_and_need_no_shuffle(spark):
    docs = corpus(spark)
    sents = sg.sentences(docs)
    for size in (1, 2, 3):
        expected = sorted(map(tuple, sg.adjacent_tfidf_distance(sg.sentence_windows(sents, size)).collect()))
        assert len(expected) > 100
        for series in (sg.text_series(docs, size), sg.sentence_series(sents, size)):
            found = sorted(map(tuple, series.collect()))
            assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in expected]
            assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(found, expected))
    held = spark.read.schema(docs.schema).json(spark.sparkContext.parallelize(docs.toJSON().collect()))
    assert "Exchange" not in sg.text_series(held)._jdf.queryExecution().executedPlan().toString()
