"""Requirements (``benchmark``) against implementations (``documents``); code units against turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import align as al, weighted as we
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.corpora import BOTH, _both
from lexiloom.plans.registry import register, table_fn
from lexiloom.session import settle

THRESHOLD = 0.25
TRACE = f"""{BOTH},
 tk AS (SELECT side || ':' || id AS id, unnest({sp.words('text')}) AS term FROM docs), tf AS (SELECT id, term, count(*) AS n FROM tk GROUP BY ALL),
 dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), nd AS (SELECT count(*) AS n_docs FROM docs), {sp.BM25_W},
 nm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY id),
 bs AS (SELECT a.id AS lid, b.id AS rid, round(least(sum(a.w * b.w) / (any_value(x.nrm) * any_value(y.nrm)), 1.0), 6) AS sim FROM wt a JOIN wt b ON a.term = b.term JOIN nm x ON x.id = a.id JOIN nm y ON y.id = b.id
   WHERE a.id LIKE 'a:%' AND b.id LIKE 'b:%' GROUP BY ALL),
 li AS (SELECT DISTINCT side || ':' || id AS id, side, unnest(regexp_extract_all(text, '[0-9]{{2,}}')) AS literal FROM docs),
 ln AS (SELECT id, count(*) AS needed FROM li WHERE side = 'a' GROUP BY id),
 lo AS (SELECT a.id AS lid, b.id AS rid, round(count(*) / any_value(needed)::DOUBLE, 6) AS overlap FROM li a JOIN li b ON a.literal = b.literal AND a.side = 'a' AND b.side = 'b' JOIN ln ON ln.id = a.id GROUP BY a.id, b.id HAVING count(*) >= 2),
 scores AS (SELECT coalesce(bs.lid, lo.lid) AS lid, coalesce(bs.rid, lo.rid) AS rid, greatest(coalesce(sim, 0.0), coalesce(overlap, 0.0)) AS score FROM bs FULL JOIN lo ON bs.lid = lo.lid AND bs.rid = lo.rid),
 rk AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY score DESC, rid) AS rank FROM scores),
 lm AS (SELECT a.lid, CASE WHEN a.score < {THRESHOLD} AND a.score >= {THRESHOLD / 2} AND round(a.score - coalesce(b.score, 0), 6) >= 0.05 THEN {THRESHOLD / 2} ELSE {THRESHOLD} END::DOUBLE AS "limit" FROM rk a LEFT JOIN rk b ON b.lid = a.lid AND b.rank = 2 WHERE a.rank = 1),
 edges AS (SELECT rk.lid, rid, score, rank, "limit", CASE WHEN score >= "limit" THEN 'matched' ELSE 'unmatched' END AS status FROM rk JOIN lm USING (lid) WHERE rank <= 10 OR score >= "limit")"""


def trace(spark, sf):
    """Edges of all requirements, written once for all that is read from them."""
    docs = _both(spark, sf)
    sims = we.bm25_pairs(docs, al.MIN_EDGES, al.lowest_limit(THRESHOLD))
    key = F.concat_ws(":", "side", F.col("id").cast("string"))
    numbers = docs.select("side", key.alias("id"), F.explode(tx.matches(F.col("text"), "[0-9]{2,}")).alias("literal")).distinct()
    overlaps = al.literal_overlaps(
        numbers.where("side = 'a'").select("id", "literal"), numbers.where("side = 'b'").select("id", "literal")
    )
    # A pair absent from sims lies below both the ten best and the lowest limit by its words alone.
    scores = sims.join(overlaps, ["lid", "rid"], "full_outer").select(
        "lid", "rid", F.greatest(F.coalesce("sim", F.lit(0.0)), F.coalesce("overlap", F.lit(0.0))).alias("score")
    )
    return settle(al.trace_edges(settle(scores), THRESHOLD))


@register("trace_edges", "J29 J30 D28", f"WITH {TRACE} SELECT * FROM edges")
def trace_edges(spark, sf):
    return trace(spark, sf)


# A match misses a literal when its document is toxic or unlabelled, a pair when its quality is low.
PREF = f"""{TRACE},
 ms AS (SELECT 'b:' || doc_id AS rid, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS mp, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS ml FROM labels),
 pf0 AS (SELECT e.*, coalesce(mp, 0) AS missing_pairs, coalesce(ml, 0) AS missing_literals FROM edges e LEFT JOIN ms USING (rid)),
 pf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY CASE WHEN status <> 'matched' THEN 1 ELSE 0 END, missing_pairs, missing_literals, score DESC, rank) AS r FROM pf0) WHERE r = 1)"""


def preferred(spark, sf, edges=None):
    edges = trace(spark, sf) if edges is None else edges
    labels = table_fn(spark, sf)("labels").select(
        F.concat(F.lit("b:"), F.col("doc_id").cast("string")).alias("rid"),
        F.when(F.col("quality") == 0, 1).otherwise(0).alias("missing_pairs"),
        F.when(F.col("toxic") == 1, 1).otherwise(0).alias("missing_literals"),
    )
    missing = edges.select("lid", "rid").join(labels, "rid")
    return al.preferred_match(edges, missing)


@register("preferred_matches", "J31", f"WITH {PREF} SELECT lid, rid, score, missing_pairs, missing_literals FROM pf")
def preferred_matches(spark, sf):
    return preferred(spark, sf).select("lid", "rid", "score", "missing_pairs", "missing_literals")


EARLIER = 0.35
DIFF = f"""{PREF},
 di AS (SELECT pf.lid, pf.rid, pf.score, CASE WHEN status <> 'matched' THEN 'SPEC_ONLY' WHEN (missing_literals > 0 OR missing_pairs > 0 OR substr(lid, 3)::BIGINT % 2 = 0) AND d.lang <> 'en' THEN 'CONFLICT' WHEN missing_literals > 0 OR missing_pairs > 0 OR substr(lid, 3)::BIGINT % 2 = 0 THEN 'DRIFTED'
   WHEN d.n_chars < 400 AND NOT h.logic THEN 'SHALLOW' ELSE 'MATCHED' END AS category FROM pf JOIN documents d ON 'b:' || d.doc_id = pf.rid JOIN (SELECT source, bool_or(lang = 'de') AS logic FROM documents GROUP BY source) h ON h.source = d.source),
 items AS (SELECT lid, rid, category, score FROM di UNION ALL SELECT 'a:' || item_id, NULL, 'SPEC_ONLY', 0.0 FROM benchmark WHERE 'a:' || item_id NOT IN (SELECT lid FROM edges) UNION ALL SELECT NULL,'b:' || doc_id, 'IMPL_ONLY', 0.0 FROM documents WHERE 'b:' || doc_id NOT IN (SELECT rid FROM edges WHERE status = 'matched'))"""


def diff(spark, sf):
    t = table_fn(spark, sf)
    edges = trace(spark, sf)
    docs = t("documents").select(F.concat(F.lit("b:"), F.col("doc_id").cast("string")).alias("rid"), "lang", "source", (F.col("n_chars") < 400).alias("type_only"))
    logic = docs.groupBy("source").agg(F.bool_or(F.col("lang") == "de").alias("file_has_logic"))
    chosen = preferred(spark, sf, edges).join(docs.join(logic, "source"), "rid")
    reqs = t("benchmark").select(F.concat(F.lit("a:"), F.col("item_id").cast("string")).alias("lid"))
    changed = chosen.where("lang <> 'en'").select("lid")
    # The tables hold one version: a requirement of an even item stood higher before, by EARLIER.
    even = F.substring("lid", 3, 20).cast("bigint") % 2 == 0
    previous = chosen.select("lid", "rid", (F.col("score") + F.when(even, EARLIER).otherwise(0.0)).alias("score"))
    found = al.diff_items(reqs, chosen, previous, changed)
    rest = al.implementation_only(docs.select("rid"), edges)
    return found.unionByName(rest.select(F.lit(None).cast("string").alias("lid"), "rid", F.lit("IMPL_ONLY").alias("category"), F.lit(0.0).alias("score")))


@register("alignment_diff", "J32", f"WITH {DIFF} SELECT * FROM items")
def alignment_diff(spark, sf):
    return diff(spark, sf)


@register("alignment_summary", "A16", f"WITH {DIFF} SELECT category, count(*) AS items FROM items GROUP BY category")
def alignment_summary(spark, sf):
    return al.category_counts(diff(spark, sf))


@register("alignment_gate", "P7", f"WITH {DIFF} SELECT bool_or(category IN ('CONFLICT', 'DRIFTED')) AS fail FROM items")
def alignment_gate(spark, sf):
    return al.should_fail(diff(spark, sf), ["CONFLICT", "DRIFTED"])


@register(
    "alignment_suggestions",
    "C6",
    f"""WITH {DIFF}, s AS (SELECT lid, rid, CASE WHEN category = 'SPEC_ONLY' THEN 'implement' WHEN category IN ('DRIFTED', 'CONFLICT') THEN 'update_implementation' END AS suggestion FROM items
  UNION ALL SELECT lid, rid, CASE WHEN category = 'IMPL_ONLY' THEN 'document' WHEN category IN ('DRIFTED', 'CONFLICT') THEN 'update_spec' END FROM items) SELECT DISTINCT * FROM s WHERE suggestion IS NOT NULL""",
)
def alignment_suggestions(spark, sf):
    return al.suggestions(diff(spark, sf), "both")


@register(
    "contiguous_implementations",
    "W12",
    """WITH u AS (SELECT l_suppkey AS file, l_returnflag AS kind, l_orderkey || ':' || l_linenumber AS id, l_orderkey AS start_line, l_orderkey + l_linenumber AS end_line FROM lineitem),
 m AS (SELECT *, max(end_line) OVER (PARTITION BY file, kind ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM u),
 b AS (SELECT *, CASE WHEN reached IS NULL OR start_line > reached + 1 THEN start_line END AS b FROM m)
 SELECT id, last_value(b IGNORE NULLS) OVER (PARTITION BY file, kind ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS group_start FROM b""",
)
def contiguous_implementations(spark, sf):
    line = table_fn(spark, sf)("lineitem")
    units = line.select(
        F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("kind"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_orderkey").alias("start_line"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end_line"),
    )
    return al.contiguous_groups(units).select("id", "group_start")


@register(
    "label_literal_overlap",
    "F32",
    """WITH e AS (SELECT user_id, event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM events),
 r AS (SELECT DISTINCT user_id AS id, event_type AS label, k AS literal FROM e), p AS (SELECT DISTINCT user_id - 1 AS id, event_type AS label, k AS literal FROM e)
 SELECT r.id, round(count(p.id) / count(*)::DOUBLE, 6) AS overlap FROM r LEFT JOIN p ON p.id = r.id AND p.label = r.label AND p.literal = r.literal GROUP BY r.id""",
)
def label_literal_overlap(spark, sf):
    # A user's (event type, number) pairs looked up in the log lines of the next user.
    ev = table_fn(spark, sf)("events").select("user_id", "event_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    required = ev.select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), F.col("k").alias("literal"))
    evidence = ev.select((F.col("user_id") - 1).alias("id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("word"), F.col("k").alias("literal"))
    return al.pair_overlaps(required, evidence)


# Units are parts: name with number, brand as namespace, brand and size as module. Fragments are notes on
# order lines; each part is written about in one way only, so every level of a match occurs.
STYLES = {
    0: ("Use ", "brand", ".", "name", " here."),
    1: ("See ", "brand", "::", "name", ", please"),
    2: ("The `", "name", "` of this order"),
    3: ("One ", "name", " was sent."),
    4: ("A part of type ", "type"),
}
_SAY = {"brand": "p_brand", "name": "p_name || ' ' || p_partkey", "type": "p_type"}
_NOTE_SQL = " ".join(f"WHEN {k} THEN " + " || ".join(_SAY.get(x) or f"'{x}'" for x in parts) for k, parts in STYLES.items())
UNIT_SQL = rf"""
 un AS (SELECT p_partkey AS unit, lower(p_name) || ' ' || p_partkey AS name, lower(p_brand) AS ns, lower(p_brand) || '/' || p_size AS module, lower(p_brand) AS project,
  CASE WHEN p_size > 40 THEN '' ELSE lower(p_type) END AS base, p_size % 7 = 0 AS inline_doc, p_size AS code_time FROM part),
 fr AS (SELECT l_orderkey || ':' || l_linenumber AS fragment, day(l_shipdate) AS doc_time, CASE l_partkey % 6 {_NOTE_SQL} ELSE 'No remark' END AS text FROM lineitem JOIN part ON l_partkey = p_partkey),
 at0 AS (SELECT fragment, list_filter(list_transform(string_split_regex(lower(text), '[^a-z0-9_#.:`\-]+'), lambda a: regexp_replace(a, '^[.:\-]+|[.:\-]+$', '', 'g')), lambda a: a <> '') AS ats FROM fr),
 gr AS (SELECT fragment, ats, unnest(range(1, 4)) AS n FROM at0), gk AS (SELECT fragment, unnest(list_transform(range(1, len(ats) - n + 2), lambda i: array_to_string(ats[i:i + n - 1], ' '))) AS key FROM gr),
 fk AS (SELECT key, min(fragment) AS fragment FROM (SELECT fragment, key FROM gk UNION ALL SELECT fragment, replace(key, '`', '') FROM gk UNION ALL SELECT fragment, 'file:' || replace(unnest(ats), '`', '') FROM at0) GROUP BY key),
 uk AS (SELECT unit, ns || '.' || name AS key, 100 AS score FROM un UNION ALL SELECT unit, ns || '::' || name, 95 FROM un UNION ALL SELECT unit, '`' || name || '`', 92 FROM un
  UNION ALL SELECT unit, name, 85 FROM un UNION ALL SELECT unit, 'file:' || base, 45 FROM un WHERE base <> ''),
 best AS (SELECT unit, fragment, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, fragment) AS r FROM uk JOIN fk USING (key)) WHERE r = 1)"""


def units(spark, sf):
    part, size = table_fn(spark, sf)("part"), F.col("p_size")
    brand = F.lower("p_brand")
    return part.select(
        F.col("p_partkey").alias("unit"), F.concat(F.lower("p_name"), F.lit(" "), F.col("p_partkey")).alias("name"), brand.alias("ns"),
        F.concat(brand, F.lit("/"), size).alias("module"), brand.alias("project"), F.when(size > 40, "").otherwise(F.lower("p_type")).alias("base"),
        (size % 7 == 0).alias("inline_doc"), size.alias("code_time"),
    )


def notes(spark, sf):
    """(fragment, doc_time, text): what order lines say about their parts."""
    t = table_fn(spark, sf)
    part = t("part").select("p_partkey", "p_brand", "p_type", F.concat("p_name", F.lit(" "), F.col("p_partkey")).alias("p_name"))
    # A part is a few bytes in its file and many in memory: by the file's size alone, all parts would be broadcast.
    lines = t("lineitem").join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    said = {"brand": F.col("p_brand"), "name": F.col("p_name"), "type": F.col("p_type")}
    text = F.lit("No remark")
    for k, parts in STYLES.items():
        text = F.when(F.col("l_partkey") % 6 == k, F.concat(*(said[x] if x in said else F.lit(x) for x in parts))).otherwise(text)
    return lines.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("fragment"), F.dayofmonth("l_shipdate").alias("doc_time"), text.alias("text"))


@register("unit_fragment_matches", "J24 D27", f"WITH {UNIT_SQL} SELECT unit, fragment, score FROM best")
def unit_fragment_matches(spark, sf):
    return al.best_fragment(units(spark, sf), notes(spark, sf))


COVER = f"""
 mtk AS (SELECT DISTINCT module, unnest({sp.words('name')}) AS token FROM un), ft AS (SELECT DISTINCT fragment, unnest({sp.words('text')}) AS token FROM fr),
 ftk AS (SELECT list_sort(list(token)) AS tokens FROM ft GROUP BY fragment), fts AS (SELECT row_number() OVER () AS s, tokens FROM (SELECT DISTINCT tokens FROM ftk)), fu AS (SELECT s, unnest(tokens) AS token FROM fts),
 cov AS (SELECT DISTINCT module FROM (SELECT module, s, count(*) AS k, bool_or(NOT regexp_matches(token, '^[0-9]+$') AND (regexp_matches(token, '[-_.]') OR (length(token) < 5 AND regexp_matches(token, '[0-9]')) OR length(token) >= 5)) AS a FROM mtk JOIN fu USING (token) GROUP BY ALL) WHERE k >= 2 AND a)"""


def covered(spark, sf):
    names = units(spark, sf).select("module", F.explode(tx.word_tokens(F.col("name"))).alias("token")).distinct()
    texts = notes(spark, sf).select(F.col("text").alias("fragment")).distinct()
    words = texts.select("fragment", F.explode(F.array_distinct(tx.word_tokens(F.col("fragment")))).alias("token"))
    return al.covered_modules(names, words)


@register("covered_modules", "J26", f"WITH {UNIT_SQL}, {COVER} SELECT module FROM cov")
def covered_modules(spark, sf):
    return covered(spark, sf)


@register(
    "undocumented_units",
    "J25",
    f"WITH {UNIT_SQL}, {COVER} SELECT unit FROM un WHERE NOT inline_doc AND unit NOT IN (SELECT unit FROM best) AND module NOT IN (SELECT module FROM cov)",
)
def undocumented_units(spark, sf):
    every = units(spark, sf)
    matched = al.best_fragment(every, notes(spark, sf)).select("unit")
    open_units = every.where("NOT inline_doc").join(matched.hint("merge"), "unit", "left_anti")
    return open_units.join(covered(spark, sf).hint("merge"), "module", "left_anti").select("unit")


STATUS_SQL = f"""{UNIT_SQL},
 tr AS (SELECT un.unit, module, project, score, CASE WHEN abs(code_time - doc_time) <= 2 THEN 'in_sync' WHEN code_time - doc_time > 0 THEN 'doc_older' ELSE 'doc_newer' END AS relation FROM best JOIN un USING (unit) JOIN (SELECT fragment, max(doc_time) AS doc_time FROM fr GROUP BY fragment) USING (fragment)),
 cs AS (SELECT *, CASE WHEN relation = 'doc_older' THEN 'stale_doc' WHEN relation = 'doc_newer' AND score >= 85 THEN 'in_sync' WHEN relation = 'doc_newer' THEN 'review_both' WHEN score < 80 THEN 'review_mapping' ELSE 'in_sync' END AS status FROM tr),
 mo AS (SELECT module AS path, status, count(*) AS candidates FROM cs GROUP BY ALL), pj AS (SELECT project AS path, status, count(*) AS candidates, count(DISTINCT module) AS modules FROM cs GROUP BY ALL),
 ag AS (SELECT 'module' AS scope, path, status, candidates FROM mo WHERE candidates >= 2 UNION ALL SELECT 'project', path, status, candidates FROM pj WHERE candidates >= 3 AND modules >= 2)"""


def candidates(spark, sf):
    """Matched units with the age of both sides: part size and day of shipping stand for the times."""
    best = settle(al.best_fragment(units(spark, sf), notes(spark, sf)))
    dated = notes(spark, sf).join(best.select("fragment").distinct(), "fragment", "left_semi").groupBy("fragment").agg(F.max("doc_time").alias("doc_time"))
    rows = best.join(units(spark, sf).select("unit", "module", "project", "code_time"), "unit").join(dated, "fragment")
    rows = rows.withColumn("relation", al.time_relation(F.col("code_time"), F.col("doc_time"), 2))
    return settle(rows.withColumn("status", al.match_status(F.col("relation"), F.col("score"))))


@register("match_statuses", "J27", f"WITH {STATUS_SQL} SELECT unit, relation, status FROM cs")
def match_statuses(spark, sf):
    return candidates(spark, sf).select("unit", "relation", "status")


@register("aggregate_suggestions", "A14", f"WITH {STATUS_SQL} SELECT * FROM ag")
def aggregate_suggestions(spark, sf):
    return al.aggregate_suggestions(candidates(spark, sf))


@register(
    "uncovered_candidates",
    "J28",
    f"WITH {STATUS_SQL} SELECT unit, status FROM cs WHERE NOT EXISTS (SELECT 1 FROM ag WHERE ag.status = cs.status AND ((scope = 'module' AND path = module) OR (scope = 'project' AND path = project)))",
)
def uncovered_candidates(spark, sf):
    rows = candidates(spark, sf)
    return al.uncovered_candidates(rows, al.aggregate_suggestions(rows)).select("unit", "status")


@register(
    "reconcile_summary",
    "A15",
    f"WITH {STATUS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'stale_doc') AS stale_doc, count(*) FILTER (status = 'in_sync') AS in_sync, count(*) FILTER (status LIKE 'review%') AS review, count(DISTINCT module) AS modules FROM cs",
)
def reconcile_summary(spark, sf):
    rows = candidates(spark, sf).groupBy("module").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "stale_doc").alias("stale"),
        F.count_if(F.col("status") == "in_sync").alias("sync"), F.count_if(F.col("status").startswith("review")).alias("rev"),
    )
    return rows.agg(F.sum("n").alias("total"), F.sum("stale").alias("stale_doc"), F.sum("sync").alias("in_sync"), F.sum("rev").alias("review"), F.count("module").alias("modules"))


@register(
    "snapshot_history",
    "I7",
    """WITH r AS (SELECT user_id AS series, event_id AS run, event_type AS fingerprint, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nx FROM events)
 SELECT series, run, fingerprint FROM r WHERE nx IS NULL OR nx <> fingerprint""",
)
def snapshot_history(spark, sf):
    ev = table_fn(spark, sf)("events").select(F.col("user_id").alias("series"), F.col("event_id").alias("run"), F.col("event_type").alias("fingerprint"))
    return al.snapshot_history(ev)
