"""Tasks against documents: no operator puts out a row per pair, window or shared word of a document and a task."""

import pytest
from rows import most_rows

from lexiloom.functions import text as tx
from lexiloom.plans import searching as sx

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["focus_windows", "owner_relevance", "task_relevance"])
def test_rows_follow_the_words_of_the_documents(spark, query):
    tokens = spark.read.parquet(f"{SF}/documents.parquet").select(tx.F.size(tx.task_token_stream(tx.F.col("text"))).alias("n"))
    words = tokens.agg({"n": "sum"}).first()[0]
    found, rows = most_rows(spark, lambda: getattr(sx, query)(spark, SF).collect())
    assert found and rows <= words, (rows, words)
