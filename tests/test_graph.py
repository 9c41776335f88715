import re

from lexiloom.operators import graph as gr, structure as st
from lexiloom.plans.catalog import COVERS, ORACLES, QUERIES


def test_reach_and_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r["id"]: r["depth"] for r in gr.reach(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    depths = {r["id"]: r["depth"] for r in gr.depth_from_leaves(edges).collect()}
    assert depths == {"d": 0, "c": 1, "b": 2, "a": 3, "x": None, "y": None, "z": None}
    assert sorted((r["src"], r["dst"]) for r in gr.circular_edges(edges).collect()) == [("x", "y"), ("y", "x")]


def test_two_cycles_joined_by_a_bridge(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3)], "src long, dst long")
    comp = {r["id"]: r["component"] for r in gr.strong_components(edges).collect()}
    assert comp == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}


def test_markdown_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\ntext a\ntext b\n## Empty\n# Two\nlast\n")], "doc_id long, text string")
    secs = st.sections(st.markdown_lines(docs)).orderBy("section").collect()
    assert [(r["title"], r["level"], r["content"]) for r in secs] == [("One", 1, "text a\ntext b"), ("Two", 1, "last")]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert all(COVERS[n] for n in QUERIES)


def test_no_cartesian_product_in_the_similarity_join(spark):
    plan = QUERIES["tfidf_near_duplicates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and not re.search("BatchEvalPython", plan)


def test_long_chains_and_cycles_settle(spark):
    from lexiloom.operators import components, graph

    chain = spark.range(12).selectExpr("id AS src", "id + 1 AS dst")
    depth = {r["id"]: r["depth"] for r in graph.depth_from_leaves(chain).collect()}
    assert depth == {i: 12 - i for i in range(13)}
    found = components.connected_components(chain.selectExpr("src AS id1", "dst AS id2")).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 13
