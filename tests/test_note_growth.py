"""Notes on many parts: equal texts are read once, and numbers beside a common word do not meet each other."""

from rows import most_rows

from lexiloom.operators import align as al


def test_a_common_word_does_not_multiply_the_numbers_beside_it(spark):
    n = 1500
    modules = [(f"m{k % 3}", t) for k in range(n) for t in (str(k),)] + [(f"m{k}", "common") for k in range(2)]
    notes = [(f"f{k}", t) for k in range(n) for t in ("common", str(k))]
    left, right = spark.createDataFrame(modules, "module string, token string"), spark.createDataFrame(notes, "fragment string, token string")
    found, rows = most_rows(spark, lambda: al.covered_modules(left, right).collect())
    assert {r["module"] for r in found} == {"m0", "m1"}
    assert rows <= 8 * n


def test_equal_texts_are_cut_into_keys_once(spark):
    texts = [(f"{k:05}", "See io.open file, and more words that name nothing here") for k in range(2000, 0, -1)] + [("x", None)]
    units = spark.createDataFrame([(1, "open file", "io", "")], "unit bigint, name string, ns string, base string")
    fragments = spark.createDataFrame(texts, "fragment string, text string")
    found, rows = most_rows(spark, lambda: [tuple(r) for r in al.best_fragment(units, fragments).collect()])
    assert found == [(1, "00001", 100)]
    assert rows <= len(texts)
