"""Units named in texts: all levels, names of several words, coverage by pairs of tokens."""

import random
from itertools import combinations

from lexiloom.operators import align as al

UNITS = "unit bigint, name string, ns string, base string"


def test_every_level_of_a_match(spark):
    units = [(1, "open file", "io", "disk"), (2, "open file", "net", ""), (3, "close", "io", "disk"), (4, "seek", None, "disk"), (5, "none", "x", ""), (6, "Open", "a", "b")]
    texts = [("z1", "Call IO.open file, then wait."), ("z2", "net::open file"), ("a3", "see `close`."), ("b4", "then seek-ing; Seek! again"), ("b5", "open. file"), ("c1", "all of disk"), ("a0", "`open file` here")]
    found = al.best_fragment(spark.createDataFrame(units, UNITS), spark.createDataFrame(texts, "fragment string, text string")).collect()
    assert {r["unit"]: (r["score"], r["fragment"]) for r in found} == {
        1: (100, "z1"), 2: (95, "z2"), 3: (92, "a3"), 4: (85, "b4"), 6: (85, "a0"),
    }


def test_file_names_come_last(spark):
    units = spark.createDataFrame([(1, "gone", "io", "Disk"), (2, "gone too", None, "")], UNITS)
    texts = spark.createDataFrame([("b", "a disk."), ("a", "no"), ("c", None), ("d", "")], "fragment string, text string")
    assert [tuple(r) for r in al.best_fragment(units, texts).collect()] == [(1, "b", 45)]


def test_modules_are_covered_by_two_tokens_of_one_fragment(spark):
    rnd = random.Random(1)
    vocab = ["common", "words", "a1", "bb", "cc", "long-one", "123", "dd"]
    modules = {f"m{k}": set(rnd.sample(vocab, rnd.randint(1, 4))) for k in range(30)}
    frags = {f"f{k}": set(rnd.sample(vocab, rnd.randint(1, 3))) for k in range(8)}
    specific = {"common", "words", "a1", "long-one"}
    want = {m for m, t in modules.items() for f in frags.values() if len(t & f) >= 2 and t & f & specific}
    rows = lambda d: [(k, t) for k, ts in d.items() for t in ts]
    got = al.covered_modules(spark.createDataFrame(rows(modules), "module string, token string"), spark.createDataFrame(rows(frags), "fragment string, token string"))
    assert {r["module"] for r in got.collect()} == want
    assert any(not (set(p) & specific) for p in combinations(vocab, 2))
