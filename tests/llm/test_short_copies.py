"""Half copies of short texts keep a common fingerprint."""

import random

import pytest

from lexiloom.llm import winnowing


@pytest.mark.parametrize("n", [40, 48, 60, 99, 100, 150, 199, 200, 400])
def test_half_copied_texts_are_nearer_than_the_next_text(spark, n):
    rnd = random.Random(n)
    texts = ["".join(rnd.choice("abcdefghiklmnoprstu ") for _ in range(n)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = winnowing.fingerprints(docs).select("doc_id", "near_edited", "near_next").collect()
    assert len(rows) == len(texts)
    assert [r["doc_id"] for r in rows if r["near_edited"] <= r["near_next"]] == []


def test_every_shared_run_of_twenty_code_points_shares_a_hash():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefghiklmnoprstu ") for _ in range(n))
    for _ in range(300):
        run = word(20)
        a, b = word(rnd.randint(0, 90)) + run + word(rnd.randint(0, 90)), word(rnd.randint(0, 90)) + run + word(rnd.randint(0, 90))
        assert winnowing.likeness(winnowing.winnow(a)[0], winnowing.winnow(b)[0]) > 0
