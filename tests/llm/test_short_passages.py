"""Passages of op6 that are short, hard-wrapped or repeated in one document only."""

import random

from lexiloom.llm import substring_dedup


def test_short_wrapped_and_inner_repeats_are_found(spark):
    rnd = random.Random(8)
    words = lambda n: ["".join(rnd.choice("abcdeghiklmnoprstu") for _ in range(8)) for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    near, alone, few, block, twice = words(20), words(12), words(3), words(60), words(9)
    texts = {
        0: " ".join(near), 1: " ".join(near[:-1] + words(1)),  # near copies of a short line
        2: " ".join(alone), 3: " ".join(words(30)) + "\n" + " ".join(alone).upper(),  # exact copies
        4: " ".join(few) + "\n\n" + " ".join(words(6)), 5: " ".join(words(6)) + "\n\n" + " ".join(few),  # under five words
        6: wrap(block, 9), 7: " ".join(words(7)) + "\n \n" + wrap(block[:-1] + words(1), 7),  # wrapped in two ways
        8: "\n".join([" ".join(twice), " ".join(words(11)), " ".join(twice)]),  # in one document only
        9: " ".join(words(40)) + "\n" + " ".join(words(2)),  # a block and its own first line are no repeat
        10: " ".join(words(15)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["at"], r["n_words"], r["removed"]) for r in substring_dedup.repeated_passages(docs).where("kind = 'paragraph'").collect())
    assert got == [
        (0, 0, 20, False), (1, 0, 20, True), (2, 0, 12, False), (3, 30, 12, True), (4, 0, 3, False), (5, 6, 3, True),
        (6, 0, 60, False), (7, 7, 60, True), (8, 0, 9, False), (8, 20, 9, True),
    ]
