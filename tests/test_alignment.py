"""Requirement diffs, acts and page proposals on literal rows."""

from lexiloom.operators import align as al, structure as st


def test_diff_lists_requirements_without_edge_and_score_drops(spark):
    reqs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "lid string")
    chosen = spark.createDataFrame(
        [("b", "x", 0.5, "matched", 0, 0, False, True), ("c", "y", 0.5, "matched", 0, 0, False, True), ("d", "z", 0.1, "unmatched", 0, 0, False, True)],
        "lid string, rid string, score double, status string, missing_pairs int, missing_literals int, type_only boolean, file_has_logic boolean",
    )
    previous = spark.createDataFrame([("b", "x", 0.9), ("c", "y", 0.6)], "lid string, rid string, score double")
    changed = spark.createDataFrame([], "lid string")
    got = {r["lid"]: (r["rid"], r["category"]) for r in al.diff_items(reqs, chosen, previous, changed).collect()}
    assert got == {"a": (None, "SPEC_ONLY"), "b": ("x", "DRIFTED"), "c": ("y", "MATCHED"), "d": ("z", "SPEC_ONLY")}


LINES = [(1, 1, "Intro", 1), (1, 2, "text", None), (2, 1, "no", None), (2, 2, "heading", None)]


def _lines(spark, rows):
    return spark.createDataFrame(rows, "id bigint, line_no int, line string, level int")


def test_document_without_sections_is_one_act(spark):
    lines = _lines(spark, LINES)
    got = sorted(tuple(r) for r in st.numbered_acts(st.sections(lines), lines).collect())
    assert got == [(1, 1, "Intro", "text"), (2, 1, "2", "no\nheading")]


def test_acts_are_not_capped(spark):
    rows = [(7, 2 * k + d, f"t{k}" if d == 0 else "body", 1 if d == 0 else None) for k in range(60) for d in (0, 1)]
    lines = _lines(spark, rows)
    assert st.numbered_acts(st.sections(lines), lines).count() == 60


def test_titles_that_agree_in_24_characters_have_their_own_pages(spark):
    same = "a title of many letters and "
    lines = _lines(spark, [(1, 1, same + "one", 1), (1, 2, "x", None), (1, 3, same + "two", 1), (1, 4, "yy", None)])
    docs = spark.createDataFrame([(1, 60), (2, 9)], "id bigint, chars int")
    got = {r["page_id"]: r["chars"] for r in st.page_proposals(st.sections(lines), docs).collect()}
    assert len(got) == 3 and got["2"] == 9
