"""Pages of different hosts: copies count on every host they lie on."""

from __spark_entry__ import queries


def test_copies_on_other_hosts_keep_their_pairs(spark, tmp_path):
    one, near, far = ("<a>" + "<b></b>" * 18 + end + "</a>" for end in ("<c></c>", "<d></d>", "<x></x>" * 30))
    pages = [(1, "http://h1/a", one), (2, "http://h1/b", one), (3, "http://h2/a", one), (4, "http://h1/c", near), (5, "http://h3/a", near), (6, "http://h3/b", far)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r["id1"], r["id2"], r["sim"]) for r in queries()["similar_page_trees_cross_host"](spark, str(tmp_path)).collect())
    assert found == [(1, 3, 1.0), (1, 5, 0.95), (2, 3, 1.0), (2, 5, 0.95), (3, 4, 0.95), (3, 5, 0.95), (4, 5, 1.0)]
