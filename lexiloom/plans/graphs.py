"""Graph queries over links between the tables and between pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import components as cc, graph as gr, prefix as px
from lexiloom.plans.lexical import folded_pairs
from lexiloom.plans.dedup import CLUSTER_SQL
from lexiloom.plans.registry import register, table_fn

E_SQL = """
 edges AS (
  SELECT 'depends_on' AS kind, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'n_regionkey' AS via, NULL AS ns FROM nation
  UNION ALL SELECT 'depends_on', 'customer:' || c_custkey, 'nation:' || c_nationkey, 'c_nationkey', NULL FROM customer
  UNION ALL SELECT 'depends_on', 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 's_nationkey', NULL FROM supplier
  UNION ALL SELECT 'depends_on', 'order:' || o_orderkey, 'customer:' || o_custkey, 'o_custkey', NULL FROM orders
  UNION ALL SELECT DISTINCT 'calls', 'order:' || l_orderkey, 'part:' || l_partkey, 'l_partkey', NULL FROM lineitem
  UNION ALL SELECT DISTINCT 'calls', 'part:' || l_partkey, 'supplier:' || l_suppkey, 'l_suppkey', NULL FROM lineitem
  UNION ALL SELECT 'references', 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'l_linenumber', NULL FROM lineitem
  UNION ALL SELECT 'declares', 'customer:' || o_custkey, 'order:' || o_orderkey, 'o_orderkey', CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END FROM orders
  UNION ALL SELECT 'extends', 'part:' || p_partkey, 'brand:' || p_brand, 'p_brand', NULL FROM part
  UNION ALL SELECT DISTINCT 'extends', 'brand:' || p_brand, 'size:' || (p_size % 5), 'p_size', NULL FROM part)"""


def _id(prefix, col):
    return F.concat(F.lit(prefix + ":"), F.col(col).cast("string"))


def code_edges(spark, sf):
    """Edge table of the star schema: containment, use, reference, declaration and kind."""
    t = table_fn(spark, sf)

    def rows(df, kind, src, dst, via, ns=None, distinct=False):
        out = df.select(src.alias("src"), dst.alias("dst"), (ns if ns is not None else F.lit(None)).cast("string").alias("ns"))
        if distinct:
            out = out.distinct()
        return out.select(F.lit(kind).alias("kind"), "src", "dst", F.lit(via).alias("via"), "ns")

    line, orders, part = t("lineitem"), t("orders"), t("part")
    parts = [
        rows(t("nation"), "depends_on", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "n_regionkey"),
        rows(t("customer"), "depends_on", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "c_nationkey"),
        rows(t("supplier"), "depends_on", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "s_nationkey"),
        rows(orders, "depends_on", _id("order", "o_orderkey"), _id("customer", "o_custkey"), "o_custkey"),
        rows(line, "calls", _id("order", "l_orderkey"), _id("part", "l_partkey"), "l_partkey", distinct=True),
        rows(line, "calls", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "l_suppkey", distinct=True),
        rows(line, "references", _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "l_linenumber"),
        rows(orders, "declares", _id("customer", "o_custkey"), _id("order", "o_orderkey"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))),
        rows(part, "extends", _id("part", "p_partkey"), _id("brand", "p_brand"), "p_brand"),
        rows(part, "extends", _id("brand", "p_brand"), F.concat(F.lit("size:"), (F.col("p_size") % 5).cast("string")), "p_size", distinct=True),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


EV_SQL = """
 ev AS (SELECT 'u' || user_id || ':' || event_type AS node, user_id, ts, event_id FROM events),
 nx AS (SELECT node AS src, lead(node) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev),
 tr AS (SELECT DISTINCT src, dst FROM nx WHERE dst IS NOT NULL)"""


def transitions(spark, sf):
    """Distinct steps between event types of one user: a graph with cycles."""
    ev = table_fn(spark, sf)("events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("src"), "user_id", "ts", "event_id"
    )
    group, order = ["user_id"], ["ts", "event_id"]
    steps = px.following(px.ranged(ev, group, order), group, order, "src", "dst")
    return steps.select("src", "dst").where("dst IS NOT NULL").distinct()


@register("module_dependencies", "G3 D17 D18", f"WITH {E_SQL} SELECT src, dst, via FROM edges WHERE kind = 'depends_on'")
def module_dependencies(spark, sf):
    return gr.of_kind(code_edges(spark, sf), "depends_on").select("src", "dst", "via")


@register(
    "direct_dependents",
    "G4",
    f"WITH {E_SQL} SELECT dst AS id, count(*) AS dependents FROM edges WHERE kind = 'depends_on' GROUP BY dst",
)
def direct_dependents(spark, sf):
    return gr.of_kind(code_edges(spark, sf), "depends_on").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))


def _reach_sql(kind, seed, flip=False, depth=64):
    a, b = ("dst", "src") if flip else ("src", "dst")
    return f"""WITH RECURSIVE {E_SQL}, k AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE kind IN {kind}),
 r(id, depth) AS (SELECT '{seed}', 0 UNION SELECT k.b, r.depth + 1 FROM r JOIN k ON k.a = r.id WHERE r.depth < {depth})
 SELECT id, min(depth) AS depth FROM r GROUP BY id"""


def _seed(spark, node):
    return spark.range(1).select(F.lit(node).alias("id"))


@register("transitive_dependencies", "G5", _reach_sql("('depends_on', 'calls')", "order:1"))
def transitive_dependencies(spark, sf):
    edges = gr.of_kind(code_edges(spark, sf), "depends_on", "calls").select("src", "dst").distinct()
    return gr.reach(edges, _seed(spark, "order:1"))


@register("transitive_dependents", "G5 G8", _reach_sql("('depends_on')", "region:2", True))
def transitive_dependents(spark, sf):
    edges = gr.of_kind(code_edges(spark, sf), "depends_on")
    return gr.reach(gr.reversed_edges(edges).distinct(), _seed(spark, "region:2"))


@register(
    "circular_edges",
    "G6",
    f"""WITH RECURSIVE {EV_SQL}, c(a, b) AS (SELECT src, dst FROM tr UNION SELECT c.a, tr.dst FROM c JOIN tr ON tr.src = c.b)
 SELECT tr.src, tr.dst FROM tr WHERE EXISTS (SELECT 1 FROM c WHERE c.a = tr.dst AND c.b = tr.src) OR tr.src = tr.dst""",
)
def circular_edges(spark, sf):
    return gr.circular_edges(transitions(spark, sf))


@register(
    "call_degrees",
    "G7 G22",
    f"""WITH {E_SQL}, k AS (SELECT src, dst FROM edges WHERE kind = 'calls'),
 o AS (SELECT src AS id, count(*) AS callees FROM k GROUP BY src), i AS (SELECT dst AS id, count(*) AS callers FROM k GROUP BY dst)
 SELECT coalesce(o.id, i.id) AS id, coalesce(callees, 0) AS callees, coalesce(callers, 0) AS callers FROM o FULL JOIN i ON o.id = i.id""",
)
def call_degrees(spark, sf):
    calls = gr.of_kind(code_edges(spark, sf), "calls")
    both = calls.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        calls.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.groupBy("id").agg(F.sum("o").alias("callees"), F.sum("i").alias("callers"))


@register("call_chain", "G8", _reach_sql("('calls')", "order:1", depth=10))
def call_chain(spark, sf):
    return gr.reach(gr.of_kind(code_edges(spark, sf), "calls"), _seed(spark, "order:1"), max_depth=10)


@register("type_hierarchy", "G9", f"WITH {E_SQL} SELECT src AS child, dst AS parent FROM edges WHERE kind = 'extends'")
def type_hierarchy(spark, sf):
    return gr.of_kind(code_edges(spark, sf), "extends").select(F.col("src").alias("child"), F.col("dst").alias("parent"))


@register("type_ancestors", "G10", _reach_sql("('extends')", "part:1"))
def type_ancestors(spark, sf):
    return gr.reach(gr.of_kind(code_edges(spark, sf), "extends"), _seed(spark, "part:1"))


@register("type_descendants", "G10", _reach_sql("('extends')", "size:3", True))
def type_descendants(spark, sf):
    return gr.reach(gr.reversed_edges(gr.of_kind(code_edges(spark, sf), "extends")), _seed(spark, "size:3"))


@register(
    "module_declarations",
    "G11",
    f"WITH {E_SQL} SELECT src AS module, dst AS symbol, coalesce(ns, 'value') AS ns FROM edges WHERE kind = 'declares'",
)
def module_declarations(spark, sf):
    d = gr.of_kind(code_edges(spark, sf), "declares")
    return d.select(F.col("src").alias("module"), F.col("dst").alias("symbol"), F.coalesce("ns", F.lit("value")).alias("ns"))


@register("reference_counts", "A12 G11", f"WITH {E_SQL} SELECT dst AS id, count(*) AS refs FROM edges WHERE kind = 'references' GROUP BY dst")
def reference_counts(spark, sf):
    return gr.of_kind(code_edges(spark, sf), "references").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("refs"))


def _depth_sql(flip):
    a, b = ("dst", "src") if flip else ("src", "dst")
    return f"""WITH RECURSIVE {E_SQL}, k AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges WHERE kind IN ('depends_on', 'calls')),
 r(id, depth) AS (SELECT DISTINCT b, 0 FROM k WHERE b NOT IN (SELECT a FROM k) UNION SELECT k.a, r.depth + 1 FROM r JOIN k ON k.b = r.id)
 SELECT id, max(depth) AS depth FROM r GROUP BY id"""


@register("bottom_up_depth", "G12 G14", _depth_sql(False))
def bottom_up_depth(spark, sf):
    return gr.depth_from_leaves(gr.of_kind(code_edges(spark, sf), "depends_on", "calls"))


@register("top_down_depth", "G13 G14", _depth_sql(True))
def top_down_depth(spark, sf):
    return gr.depth_from_leaves(gr.reversed_edges(gr.of_kind(code_edges(spark, sf), "depends_on", "calls")))


@register(
    "unordered_nodes",
    "G12",
    f"""WITH RECURSIVE {EV_SQL}, k AS (SELECT * FROM tr WHERE src <> dst), c(a, b) AS (SELECT src, dst FROM k UNION SELECT c.a, k.dst FROM c JOIN k ON k.src = c.b)
 SELECT DISTINCT c.a AS id FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.a = c.b AND x.b = c.b)""",
)
def unordered_nodes(spark, sf):
    return gr.depth_from_leaves(transitions(spark, sf)).where("depth IS NULL").select("id")


DIGEST = "sha256(count({c})::VARCHAR || '|' || coalesce(sum(('0x' || substr(sha256({c}), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR)"


@register(
    "function_units",
    "G15 F17 D19",
    f"""{_depth_sql(False).replace('SELECT id, max(depth) AS depth FROM r GROUP BY id', '')},
 dp AS (SELECT id, max(depth) AS depth FROM r GROUP BY id), cl AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'),
 i AS (SELECT dst AS id, count(*) AS callers, {DIGEST.format(c='src')} AS dg FROM cl GROUP BY dst),
 o AS (SELECT src AS id, count(*) AS callees, {DIGEST.format(c='dst')} AS dg FROM cl GROUP BY src),
 s AS (SELECT 'part:' || p_partkey AS id, p_brand AS file, sha256(p_name) AS h FROM part)
 SELECT s.id, file, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees,
   sha256(h || '|' || coalesce(i.dg, '') || '|' || coalesce(o.dg, '')) AS context_hash, coalesce(depth, 0) AS depth
 FROM s LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN dp USING (id)""",
)
def function_units(spark, sf):
    edges = code_edges(spark, sf)
    symbols = table_fn(spark, sf)("part").select(
        _id("part", "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.sha2("p_name", 256).alias("source_hash")
    )
    depths = gr.depth_from_leaves(gr.of_kind(edges, "depends_on", "calls"))
    return gr.function_units(symbols, gr.of_kind(edges, "calls"), depths)


LINK_SQL = "lk AS (SELECT DISTINCT page_id AS page, unnest(regexp_extract_all(html, 'href=\"([^\"#]+)', 1)) AS target FROM pages)"


def page_links(spark, sf):
    pages = table_fn(spark, sf)("pages")
    links = pages.select(F.col("page_id").alias("page"), F.explode_outer(tx.href_targets(F.col("html"))).alias("target"))
    return links.where("target IS NOT NULL").distinct()


@register("page_link_targets", "F20", f"WITH {LINK_SQL} SELECT page, target FROM lk")
def page_link_targets(spark, sf):
    return page_links(spark, sf)


@register("hub_pages", "G16", f"WITH {LINK_SQL} SELECT target, count(*) AS incoming FROM lk GROUP BY target HAVING count(*) >= 2 ORDER BY incoming DESC, target LIMIT 10")
def hub_pages(spark, sf):
    return gr.hubs(page_links(spark, sf))


@register(
    "orphan_orders",
    "G17",
    """SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
 AND o_orderkey NOT IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)""",
)
def orphan_orders(spark, sf):
    from lexiloom.operators import lint

    t = table_fn(spark, sf)
    orders = t("orders")
    linked = t("lineitem").select(F.col("l_orderkey").alias("id"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("id")).select("id")
    return lint.orphans(orders.select(F.col("o_orderkey").alias("id")), linked, first)


@register(
    "broken_part_links",
    "G18",
    "SELECT l_orderkey AS page, l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)",
)
def broken_part_links(spark, sf):
    from lexiloom.operators import lint

    t = table_fn(spark, sf)
    links = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("target"))
    return lint.broken_links(links, t("part").where("p_size <= 40").select(F.col("p_partkey").alias("target")))


@register(
    "affected_items",
    "G19",
    CLUSTER_SQL + " SELECT id FROM reach WHERE other % 10 = 0 GROUP BY id",
)
def affected_items(spark, sf):
    from lexiloom.session import settle

    pairs = settle(folded_pairs(table_fn(spark, sf)("documents"), "tfidf"))
    both = pairs.select(F.col("id1").alias("src"), F.col("id2").alias("dst"))
    both = settle(both.unionByName(gr.reversed_edges(both)))
    changed = both.select(F.col("src").alias("id")).where("id % 10 = 0").distinct()
    return gr.reach(both, changed).select("id")


@register(
    "graph_overview",
    "G20",
    """WITH r AS (SELECT p_brand AS module, 'part:' || p_partkey AS id, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, 'part:' || p_partkey) AS rank FROM part)
 SELECT * FROM r WHERE rank <= 3""",
)
def graph_overview(spark, sf):
    symbols = table_fn(spark, sf)("part").select(F.col("p_brand").alias("module"), _id("part", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return gr.first_symbols(symbols, 3)


@register(
    "graph_export",
    "G21",
    f"""WITH {E_SQL}, d AS (SELECT src, dst FROM edges WHERE kind = 'depends_on')
 SELECT 'edge' AS item, src AS a, dst AS b FROM d UNION ALL SELECT 'node', id, '' FROM (SELECT src AS id FROM d UNION SELECT dst FROM d)""",
)
def graph_export(spark, sf):
    d = gr.of_kind(code_edges(spark, sf), "depends_on").select("src", "dst")
    nodes = d.select(F.col("src").alias("a")).unionByName(d.select(F.col("dst").alias("a"))).distinct()
    edges = d.select(F.lit("edge").alias("item"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return edges.unionByName(nodes.select(F.lit("node").alias("item"), "a", F.lit("").alias("b")))


@register("edge_counts", "G22 A17", f"WITH {E_SQL} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources FROM edges GROUP BY kind")
def edge_counts(spark, sf):
    per_source = code_edges(spark, sf).groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("kind").agg(F.sum("n").alias("edges"), F.count("src").alias("sources"))


@register(
    "symbols_by_file",
    "A17",
    "SELECT p_brand AS file, split_part(p_type, ' ', 1) AS kind, count(*) AS symbols, min(p_name) AS first_name FROM part GROUP BY ALL",
)
def symbols_by_file(spark, sf):
    part = table_fn(spark, sf)("part")
    return part.groupBy(F.col("p_brand").alias("file"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind")).agg(
        F.count(F.lit(1)).alias("symbols"), F.min("p_name").alias("first_name")
    )


@register(
    "documentation_coverage",
    "A13",
    """SELECT coalesce(source, 'TOTAL') AS pkg, count(*) AS total, count(quality) AS documented, round(count(quality) * 100.0::DOUBLE / count(*), 6) AS percent
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""",
)
def documentation_coverage(spark, sf):
    t = table_fn(spark, sf)
    both = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return (
        both.rollup("source")
        .agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("documented"))
        .select(F.coalesce("source", F.lit("TOTAL")).alias("pkg"), "total", "documented", F.round(F.col("documented") * 100.0 / F.col("total"), 6).alias("percent"))
    )


HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@register("page_categories", "A20", f"SELECT {HOST} AS category, count(*) AS pages FROM pages GROUP BY ALL")
def page_categories(spark, sf):
    return table_fn(spark, sf)("pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("category")).agg(F.count(F.lit(1)).alias("pages"))


@register(
    "module_clusters",
    "A23",
    """WITH m AS (SELECT source || '/' || lang || '/' || doc_id AS path, n_chars FROM documents)
 SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS cluster, count(DISTINCT path) AS modules, sum(n_chars)::BIGINT AS declarations FROM m GROUP BY ALL""",
)
def module_clusters(spark, sf):
    docs = table_fn(spark, sf)("documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "n_chars")
    per_path = docs.groupBy("path").agg(F.sum("n_chars").alias("n"))
    return per_path.groupBy(F.substring_index("path", "/", 2).alias("cluster")).agg(F.count("path").alias("modules"), F.sum("n").alias("declarations"))


@register(
    "canonical_edges",
    "J36",
    f"""WITH {E_SQL}, m AS (SELECT 'nation:' || n_nationkey AS old, 'geo:' || n_regionkey AS new FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'geo:' || r_regionkey FROM region),
 f AS (SELECT kind, coalesce(a.new, src) AS src, coalesce(b.new, dst) AS dst FROM edges LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst)
 SELECT * FROM f WHERE NOT (kind = 'depends_on' AND src = dst)""",
)
def canonical_edges(spark, sf):
    t = table_fn(spark, sf)
    moves = t("nation").select(_id("nation", "n_nationkey").alias("old"), _id("geo", "n_regionkey").alias("new")).unionByName(
        t("region").select(_id("region", "r_regionkey").alias("old"), _id("geo", "r_regionkey").alias("new"))
    )
    return gr.rewrite_endpoints(code_edges(spark, sf), moves)


@register(
    "repaired_call_targets",
    "J37",
    """WITH c AS (SELECT DISTINCT 'order:' || l_orderkey AS src, p_brand AS module, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
 k AS (SELECT p_brand AS module, p_name AS name, min('part:' || p_partkey) AS symbol FROM part WHERE p_size <= 40 GROUP BY ALL)
 SELECT src, coalesce(symbol, 'external:' || module) AS dst, symbol IS NOT NULL AS resolved FROM c LEFT JOIN k USING (module, name)""",
)
def repaired_call_targets(spark, sf):
    t = table_fn(spark, sf)
    part = t("part")
    calls = (
        t("lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(_id("order", "l_orderkey").alias("src"), F.col("p_brand").alias("module"), F.col("p_name").alias("name"))
        .distinct()
    )
    symbols = part.where("p_size <= 40").select(_id("part", "p_partkey").alias("id"), F.col("p_brand").alias("module"), F.col("p_name").alias("name"))
    return gr.repair_endpoints(calls, symbols)


@register(
    "wrapper_call_sites",
    "J38",
    f"""WITH {E_SQL}, c AS (SELECT src, dst FROM edges WHERE kind = 'depends_on' OR kind = 'declares'),
 w AS (SELECT src AS wrapper, min(dst) AS delegate FROM (SELECT DISTINCT src, dst FROM c) GROUP BY src HAVING count(*) = 1)
 SELECT DISTINCT c.src AS caller, wrapper, delegate FROM c JOIN w ON c.dst = wrapper""",
)
def wrapper_call_sites(spark, sf):
    return gr.wrapper_call_sites(gr.of_kind(code_edges(spark, sf), "depends_on", "declares"))


@register(
    "merged_graph_nodes",
    "S6",
    """WITH n AS (SELECT 'k' || c_nationkey AS id, 'customer' AS file, c_mktsegment AS kind, 0 AS rk, c_custkey AS o FROM customer),
 a AS (SELECT id, file, min(kind) AS kind FROM n GROUP BY ALL),
 b AS (SELECT 'k' || n_nationkey AS id, 'nation' AS file, n_name AS kind FROM nation),
 u AS (SELECT *, 0 AS rk FROM a UNION ALL SELECT *, 1 FROM b)
 SELECT id, file, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rk) AS rn FROM u) WHERE rn = 1""",
)
def merged_graph_nodes(spark, sf):
    t = table_fn(spark, sf)
    a = t("customer").groupBy(_id("k", "c_nationkey").alias("id")).agg(F.min("c_mktsegment").alias("kind"))
    a = a.select(F.replace("id", F.lit(":"), F.lit("")).alias("id"), F.lit("customer").alias("file"), "kind")
    b = t("nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("nation").alias("file"), F.col("n_name").alias("kind"))
    return gr.merge_graphs(a, b)
