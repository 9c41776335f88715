"""Input columns named like those that operators add, and rows that repeat a doc_id."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import mixing, pii, quality

TEXTS = ["mail to anna.b@example.com now please and thanks a lot", "call +1 415 555 0134 today or tomorrow please", "plain words only here", None]


def frame(spark, *extra):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in extra:
        docs = docs.withColumn(name, F.lit("own"))
    return docs


def test_scores_and_spans_get_free_names(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, "quality_score", "QUALITY_SCORE_")
    kept = quality.selected(docs, labels)
    assert kept.columns == [*docs.columns, "quality_score__"] and kept.count() == 3
    docs = frame(spark, "pii_candidates", "pii_spans", "pii_base")
    found = pii.personal_data(docs)
    assert found.columns == [*docs.columns, "pii_base_", "pii_spans_"]
    assert {r["doc_id"]: len(r["pii_spans_"]) for r in found.collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, "gone_id", "mixed_id", "mixed_source", "times", "row", "rows", "quality_score", "pii_spans", "pii_candidates", "pii_base", "component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {r["gone_id"] for r in out.collect()} <= {"own"}
    assert corpus_pipeline.bpe_encoding(spark, docs, str(tmp_path)).count() == len(TEXTS)


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_rows_that_repeat_a_doc_id_do_not_exceed_the_mix(spark):
    rows = [(1, "a " * 10, "x")] * 6 + [(2, "b " * 60, "x")] + [(10 + k, "c " * 30, "y") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r["source"]: r["n"] for r in mixing.repeated_documents(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    # Weights 5 and 2 of 240 words; documents stay whole, so a source may miss its target by one.
    assert abs(taken["x"] - 240 * 5 / 7) <= 60 and abs(taken["y"] - 240 * 2 / 7) <= 30
