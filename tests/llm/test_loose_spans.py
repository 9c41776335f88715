"""National phones and '(at)' addresses are spans, however common '+1' numbers are."""

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import pii

LOOSE = [
    ("ring (415) 555-0134 today", "ring [PHONE] today", [(5, "phone", 19)]),
    ("or 555-123-4567.", "or [PHONE].", [(3, "phone", 15)]),
    ("call 212 555 0188 now", "call [PHONE] now", [(5, "phone", 17)]),
    ("ask bob (at) ex (dot) org", "ask [EMAIL]", [(4, "email", 25)]),
    ("write joe[at]mail.example.com", "write [EMAIL]", [(6, "email", 29)]),
    # Too many digits for one number of the rules, so the parts count.
    ("x +1 (415) 555-0134 (415) 555-0199 y", "x +1 [PHONE] [PHONE] y", [(5, "phone", 19), (20, "phone", 34)]),
    # Within a number of the rules no further span is made.
    ("me +1 (415) 555-0134 ok", "me [PHONE] ok", [(3, "phone", 20)]),
]


@pytest.mark.parametrize("common", [0, 400])
def test_standalone_loose_spans_are_found_and_redacted(spark, common):
    plus = [f"number {k} of a list +1 ({200 + k}) 555-{1000 + k} or m{k}@mail.org and +1 ({k}) 5 and 300.1.{k}.7" for k in range(common)]
    docs = spark.createDataFrame(list(enumerate([t for t, _, _ in LOOSE] + plus)), "doc_id bigint, text string")
    rows = pii.personal_data(docs).where(F.col("doc_id") < len(LOOSE)).select("doc_id", "pii_spans", pii.redact(F.col("text"), F.col("pii_spans")).alias("clean")).collect()
    got = {r["doc_id"]: (r["clean"], [(s["start"], pii.KINDS[s["kind"]], s["end"]) for s in r["pii_spans"]]) for r in rows}
    assert got == {i: (clean, spans) for i, (_, clean, spans) in enumerate(LOOSE)}


def test_loose_candidates_are_no_negatives(spark):
    docs = spark.createDataFrame([(0, "+1 (415) 555-0134 and sizes 256 512 1024")], "doc_id bigint, text string")
    found = pii.candidates(docs).select(F.inline("pii_candidates")).collect()
    assert [(r["start"], r["base"], r["label"]) for r in found if r["kind"] == 3] == [(0, True, True), (28, False, None)]
    assert "plus" not in pii.FEATURES
