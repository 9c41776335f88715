import random
from itertools import combinations

from lexiloom.operators import lint


def frames(spark, held, links):
    sources = spark.createDataFrame([(p, s) for p, own in held.items() for s in own], "page long, source string")
    return sources, spark.createDataFrame(links, "page long, target long")


def test_cross_reference_gaps_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(lint, "CLASS_CHUNK", 3)
    rnd = random.Random(5)
    held = {p: frozenset(rnd.sample("abcde", rnd.choice([1, 2]))) for p in range(60)}
    links = [(p, t) for p in range(60) for t in (3, 17, 40) if rnd.random() < 0.3] + [(5, 5), (7, 99)]
    found = lint.missing_cross_references(*frames(spark, held, links), 4).collect()
    near = {frozenset(x) for x in links}
    want = [(p, q, len(held[p] & held[q])) for p, q in combinations(range(60), 2) if held[p] & held[q] and frozenset((p, q)) not in near]
    assert sorted(map(tuple, found)) == want


def test_equal_pages_are_one_class(spark):
    """Counting shared sources must not grow with the pairs of equal pages."""
    held = {p: {"x", "y"} if p % 2 else {"y", "z"} for p in range(200)}
    members = lint.page_classes(*frames(spark, held, [(p, 4) for p in range(0, 200, 2)]))
    assert {(r["id"], r["rep_id"]) for r in members.collect()} == {(p, 1 if p % 2 else 4 if p == 4 else 0) for p in range(200)}
