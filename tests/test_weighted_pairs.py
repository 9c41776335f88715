"""Requirements against documents by BM25: texts are weighed where they are read, no row per word of a text is made."""

from collections import Counter

import pyarrow as pa
import pytest
from rows import most_rows

from lexiloom.functions import text as tx
from lexiloom.operators import blocks as bl, divergence as dv, weighted as we
from lexiloom.plans import alignment

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["alignment_gate", "alignment_suggestions"])
def test_rows_stay_below_the_words_of_the_documents(spark, query):
    per_doc = spark.read.parquet(f"{SF}/documents.parquet").select(tx.F.size(tx.F.array_distinct(tx.word_tokens(tx.F.col("text")))).alias("n"))
    words = per_doc.agg({"n": "sum"}).first()[0]
    found, rows = most_rows(spark, lambda: getattr(alignment, query)(spark, SF).collect())
    assert found and 2 * rows < words, (rows, words)


DOCS = [
    ("a", 1, "Red cats, red_dogs; ÉTÉ-été x 12"), ("a", 2, "blue CATS sleep"), ("a", 3, None), ("a", 4, "日本語 only-here"),
    ("b", 1, "red cats and blue dogs"), ("b", 2, "été 日本語ＡＢ cats\u0085sleep\x1csleep"), ("b", 3, ""), ("b", 4, None), ("b", 5, "nothing shared 99"),
    # Rows of one id count as one text, and their words stay apart.
    ("b", 6, "sleep re"), ("b", 6, "d red cats"), ("b", 6, None),
    *(("b", 10 + k, f"cats number{k} sleep" + " red" * (k % 3)) for k in range(20)),
]


@pytest.mark.parametrize("frequent", [0, 3, 1 << 18])
@pytest.mark.parametrize("k,threshold", [(2, 0.9), (40, 0.3)])
def test_pairs_equal_those_of_a_join_on_terms(spark, monkeypatch, frequent, k, threshold):
    monkeypatch.setattr(we, "FREQUENT", frequent)
    docs = spark.createDataFrame(DOCS, "side string, id bigint, text string")
    weights = dv.sided_weights(docs)
    sides = (weights.where(weights.id.startswith(x)).select("id", "term", "w") for x in ("a:", "b:"))
    key = lambda rows: sorted((r["lid"], r["rid"], round(r["sim"], 5)) for r in rows)
    want = key(bl.best_pairs(*sides, k, threshold).collect())
    assert want and key(we.bm25_pairs(docs, k, threshold).collect()) == want


def test_no_texts_give_no_pairs(spark):
    assert we.bm25_pairs(spark.createDataFrame([("a", 1, None), ("b", 1, "")], "side string, id bigint, text string"), 3, 0.1).collect() == []
    assert we.bm25_pairs(spark.createDataFrame([], "side string, id bigint, text string"), 3, 0.1).collect() == []


def test_words_equal_the_tokens_of_the_columns(spark):
    texts = [t for _, _, t in DOCS if t] + ["".join(map(chr, range(1, 0x180))), "a" * 5 + "�" + "bb", "××÷÷ ŸŸ ßß À"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tx.word_tokens(tx.F.col("text")).alias("w")).collect()
    assert all([w.decode("latin-1") for w in we.words(r["text"].encode())] == r["w"] for r in rows)


def test_frequencies_handed_on_in_parts_add_up(monkeypatch):
    monkeypatch.setattr(we, "FLUSH_WORDS", 3)
    texts = [b"ab cd ab", None, b"", b"ef gh", b"cd"]
    parts = list(we._frequencies([pa.record_batch([pa.array(texts, pa.binary())], names=["text"])]))
    df, total = Counter(), Counter()
    for r in (r for p in parts for r in p.to_pylist()):
        df[r["term"]] += r["df"]
        total[r["term"]] += r["total"]
    assert len(parts) > 1 and df == {"ab": 1, "cd": 2, "ef": 1, "gh": 1, None: 3} and total[None] == 6
