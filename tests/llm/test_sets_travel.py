"""Shingle sets of paragraphs are large: meetings are arranged from their sizes, and no copy of the sets is written."""

from lexiloom.llm import substring_dedup as sd


def test_no_sets_are_written(spark, monkeypatch):
    written, settle = [], sd.settle
    monkeypatch.setattr(sd, "settle", lambda df: written.append(df.columns) or settle(df))
    base = [f"w{k}" for k in range(60)]
    near = [*base[:-1], "other"]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, "a b c")]
    found = sd.repeated_passages(spark.createDataFrame(texts, "doc_id bigint, text string")).where("kind = 'paragraph'")
    assert {(r["doc_id"], r["removed"]) for r in found.collect()} == {(1, False), (2, True)}
    assert written and not any("items" in columns for columns in written)
