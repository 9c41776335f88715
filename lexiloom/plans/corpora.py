"""Differences between corpora: ``benchmark`` (a) against ``documents`` (b), languages, roles."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from lexiloom.functions import hashing, text as tx
from lexiloom.operators import divergence as dv, lexical as lx
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.registry import register, table_fn
from lexiloom.session import settle

BOTH = """
 docs AS (SELECT 'a' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 'b', doc_id, text FROM documents)"""


def _sides_sql(extra="", source="docs", with_cte=BOTH):
    g = extra
    return f"""{with_cte},
 tk AS (SELECT {g} side, id, unnest({sp.words('text')}) AS term FROM {source}),
 tf AS (SELECT {g} side, id, term, count(*) AS n FROM tk GROUP BY ALL),
 ct AS (SELECT {g} term, coalesce(sum(n) FILTER (side = 'a'), 0)::BIGINT AS n_a, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS n_b, count(*) AS df FROM tf GROUP BY ALL),
 wt AS (SELECT *, CASE WHEN n_a > 0 THEN (1 + ln(n_a)) * CASE WHEN n_b > 0 THEN 1 ELSE ln(1.5) + 1 END ELSE 0 END AS w_a,
               CASE WHEN n_b > 0 THEN (1 + ln(n_b)) * CASE WHEN n_a > 0 THEN 1 ELSE ln(1.5) + 1 END ELSE 0 END AS w_b FROM ct)"""


DIST = "round(CASE WHEN sum(w_a*w_a) = 0 AND sum(w_b*w_b) = 0 THEN 0.0 WHEN sum(w_a*w_a) = 0 OR sum(w_b*w_b) = 0 THEN 1.0 ELSE 1 - least(sum(w_a * w_b) / sqrt(sum(w_a * w_a) * sum(w_b * w_b)), 1.0) END, 6)"
UBI = "df < greatest(floor((SELECT count(*) FROM docs) / 3) + 1, 2) AND NOT regexp_matches(term, '^-?[0-9]+$')"


def _both(spark, sf):
    t = table_fn(spark, sf)
    a = t("benchmark").select(F.lit("a").alias("side"), F.col("item_id").alias("id"), "text")
    return a.unionByName(t("documents").select(F.lit("b").alias("side"), F.col("doc_id").alias("id"), "text"))


@register("corpus_divergence", "E1", f"WITH {_sides_sql()} SELECT {DIST} AS distance FROM wt")
def corpus_divergence(spark, sf):
    return dv.corpus_distance(dv.side_counts(_both(spark, sf)))


@register(
    "gap_terms",
    "E2 D24",
    f"WITH {_sides_sql()} SELECT term, round(w_b, 6) AS weight FROM wt WHERE n_b > 0 AND n_a = 0 AND {UBI}",
)
def gap_terms(spark, sf):
    docs = _both(spark, sf)
    return dv.gap_terms(dv.side_counts(docs), lx.corpus_size(docs), "b").select("term", "weight")


@register(
    "drift_report",
    "E3",
    f"""WITH {_sides_sql()}, g AS (SELECT 'a_to_b' AS direction, term, round(w_a, 6) AS weight FROM wt WHERE n_a > 0 AND n_b = 0 AND {UBI}
  UNION ALL SELECT 'b_to_a', term, round(w_b, 6) FROM wt WHERE n_b > 0 AND n_a = 0 AND {UBI}),
 k AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY weight DESC, term) AS r FROM g), d AS (SELECT {DIST} AS distance FROM wt)
 SELECT direction, term, weight, distance, distance >= 0.3 AS drifted FROM k, d WHERE r <= 20""",
)
def drift_report(spark, sf):
    docs = _both(spark, sf)
    counts = dv.side_counts(docs)
    n = lx.corpus_size(docs)
    both = dv.gap_terms(counts, n, "a").select(F.lit("a_to_b").alias("direction"), "term", "weight").unionByName(
        dv.gap_terms(counts, n, "b").select(F.lit("b_to_a").alias("direction"), "term", "weight")
    )
    distance = dv.corpus_distance(counts).scalar()
    return dv.limited(both, 20, "direction").withColumn("distance", distance).withColumn("drifted", F.col("distance") >= 0.3)


@register(
    "spec_conformance",
    "E4",
    f"""WITH {_sides_sql()}, g AS (SELECT term, round(w_a, 6) AS weight, length(term) >= 8 AS focus FROM wt WHERE n_a > 0 AND n_b = 0 AND {UBI})
 SELECT focus, count(*) AS missing, round(sum(weight), 4) AS weight, (SELECT count(*) FROM ct WHERE n_a > 0) AS spec_terms FROM g GROUP BY focus""",
)
def spec_conformance(spark, sf):
    docs = _both(spark, sf)
    counts = dv.side_counts(docs)
    gaps = dv.gap_terms(counts, lx.corpus_size(docs), "a").withColumn("focus", F.char_length("term") >= 8)
    spec_terms = counts.where("n_a > 0").agg(F.count(F.lit(1))).scalar()
    return gaps.groupBy("focus").agg(F.count(F.lit(1)).alias("missing"), F.round(F.sum("weight"), 4).alias("weight")).withColumn("spec_terms", spec_terms)


LANG_CTE = """
 docs AS (SELECT source AS grp, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side, doc_id AS id, text FROM documents)"""


@register(
    "module_vocabulary_divergence",
    "E5",
    f"""WITH {_sides_sql('grp,', 'docs', LANG_CTE)}, d AS (SELECT grp, {DIST} AS distance FROM wt GROUP BY grp),
 nd AS (SELECT grp, count(*) AS k FROM docs GROUP BY grp),
 g AS (SELECT grp, term, round(w_a, 6) AS weight, row_number() OVER (PARTITION BY grp ORDER BY round(w_a, 6) DESC, term) AS r FROM wt JOIN nd USING (grp)
   WHERE n_a > 0 AND n_b = 0 AND df < greatest(floor(k / 3) + 1, 2) AND length(term) >= 3 AND NOT regexp_matches(term, '^-?[0-9]+$'))
 SELECT grp, distance, term, weight FROM d JOIN g USING (grp) WHERE distance >= 0.3 AND r <= 15""",
)
def module_vocabulary_divergence(spark, sf):
    docs = table_fn(spark, sf)("documents").select(
        F.col("source").alias("grp"), F.when(F.col("lang") == "en", "a").otherwise("b").alias("side"), F.col("doc_id").alias("id"), "text"
    )
    counts = dv.side_counts(docs, "grp")
    sizes = docs.groupBy("grp").agg(F.count(F.lit(1)).alias("k"))
    gaps = dv.gap_terms(counts.join(sizes, "grp"), F.col("k"), "a", min_length=3)
    far = dv.corpus_distance(counts, "grp").where("distance >= 0.3")
    return dv.limited(gaps, 15, "grp").join(far, "grp").select("grp", "distance", "term", "weight")


def _coverage_sql(src, oth):
    return f"""WITH {_sides_sql()}, dl AS (SELECT side, id, sum(n) AS dl FROM tf GROUP BY ALL), av AS (SELECT avg(dl) AS avgdl FROM dl),
 sd AS (SELECT sum(dl) AS total FROM dl WHERE side = '{src}'), sz AS (SELECT count(*) AS k FROM docs WHERE side = '{src}'), nd AS (SELECT count(*) AS n FROM docs),
 g AS (SELECT term, df, (ln((1.0 + nd.n) / (1.0 + df)) + 1) * n_{src} * 2.2 / (n_{src} + 1.2 * (0.25 + 0.75 * total / avgdl)) AS w, k
   FROM ct, av, sd, sz, nd WHERE n_{src} > 0 AND n_{oth} = 0 AND NOT regexp_matches(term, '^[0-9.,_-]*$'))
 SELECT term, round(w, 6) AS weight, round(CASE WHEN k >= 3 AND df >= k THEN w * 0.5 ELSE w END, 6) AS ranking, df AS origins FROM g"""


@register("under_coverage_terms", "E6", _coverage_sql("a", "b"))
def under_coverage_terms(spark, sf):
    return dv.coverage_gaps(_both(spark, sf), "a")


@register("out_of_source_terms", "E7", _coverage_sql("b", "a"))
def out_of_source_terms(spark, sf):
    return dv.coverage_gaps(_both(spark, sf), "b")


# A story is a conversation: its user turns are the acts, its assistant turns the implementations.
ACT_SQL = f"""
 tn AS (SELECT conv_id, turn, role, {sp.words('text')} AS toks FROM conversations WHERE role IN ('user', 'assistant')),
 tt AS (SELECT conv_id, turn, role, unnest(toks) AS term FROM tn), tf AS (SELECT conv_id, turn, role, term, count(*) AS n FROM tt GROUP BY ALL),
 dl AS (SELECT conv_id, turn, sum(n) AS dl FROM tf GROUP BY ALL),
 sn AS (SELECT conv_id, count(*) AS k FROM tn GROUP BY conv_id), sv AS (SELECT conv_id, avg(dl) AS mean FROM dl GROUP BY conv_id), sd AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
 sw AS (SELECT conv_id, turn, role, term, (ln((1.0 + k) / (1.0 + df)) + 1) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / mean)) AS w FROM tf JOIN sd USING (conv_id, term) JOIN dl USING (conv_id, turn) JOIN sn USING (conv_id) JOIN sv USING (conv_id)),
 sq AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS nrm FROM sw GROUP BY ALL),
 sm AS (SELECT a.conv_id, a.turn AS act, b.turn AS impl, round(least(sum(a.w * b.w) / any_value(x.nrm * y.nrm), 1.0), 6) AS sim FROM sw a JOIN sw b ON a.conv_id = b.conv_id AND a.term = b.term AND a.role = 'user' AND b.role = 'assistant'
   JOIN sq x ON x.conv_id = a.conv_id AND x.turn = a.turn JOIN sq y ON y.conv_id = b.conv_id AND y.turn = b.turn GROUP BY ALL)"""
PAIR_W = "CASE WHEN {n} > 0 THEN CASE WHEN na > 0 AND nb > 0 THEN 1 ELSE ln(1.5) + 1 END * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * {l} / ((la + lb) / 2.0))) ELSE 0 END"
PAIR_X = f"{PAIR_W.format(n='na', l='la')} AS wa, {PAIR_W.format(n='nb', l='lb')} AS wb"
UNION_SQL = f"""{ACT_SQL},
 ua AS (SELECT conv_id, term, sum(n) AS na FROM tf WHERE role = 'user' GROUP BY ALL), ub AS (SELECT conv_id, term, sum(n) AS nb FROM tf WHERE role = 'assistant' GROUP BY ALL),
 ta AS (SELECT conv_id, sum(na) AS la FROM ua GROUP BY ALL), ib AS (SELECT conv_id, turn AS impl, term, n AS nb FROM tf WHERE role = 'assistant'), il AS (SELECT conv_id, impl, sum(nb) AS lb FROM ib GROUP BY ALL),
 cj AS (SELECT conv_id, impl, term, na, 0 AS nb FROM il JOIN ua USING (conv_id) UNION ALL SELECT conv_id, impl, term, 0, nb FROM ib),
 ck AS (SELECT conv_id, impl, term, sum(na) AS na, sum(nb) AS nb FROM cj GROUP BY ALL),
 cx AS (SELECT conv_id, impl, {PAIR_X} FROM ck JOIN il USING (conv_id, impl) JOIN ta USING (conv_id)),
 cb AS (SELECT conv_id, impl, round(least(sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)), 1.0), 6) AS combined FROM cx GROUP BY ALL),
 ou AS (SELECT coalesce(ua.conv_id, ub.conv_id) AS conv_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM ua FULL JOIN ub ON ua.conv_id = ub.conv_id AND ua.term = ub.term),
 ol AS (SELECT conv_id, sum(na) AS la, sum(nb) AS lb FROM ou GROUP BY ALL), ox AS (SELECT conv_id, {PAIR_X} FROM ou JOIN ol USING (conv_id)),
 ov AS (SELECT conv_id, round(CASE WHEN sum(wa * wa) = 0 OR sum(wb * wb) = 0 THEN 1.0 ELSE 1 - least(sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)), 1.0) END, 6) AS overall FROM ox GROUP BY ALL)"""
FLOOR, MARGIN = 0.05, 0.03


def _turns(spark, sf):
    turns = table_fn(spark, sf)("conversations").where("role IN ('user', 'assistant')")
    side = F.when(F.col("role") == "user", "a").otherwise("b")
    return turns.select(F.col("conv_id").alias("story"), side.alias("side"), F.col("turn").alias("id"), "text")


def act_scores(spark, sf, counts=None):
    """(conv_id, act, impl, sim): user and assistant turns of a conversation, under its own weights."""
    turns = _turns(spark, sf)
    counts = dv.story_counts(turns) if counts is None else counts
    found = dv.attribution(dv.story_weights(counts, turns))
    return settle(found.select(F.col("story").alias("conv_id"), F.col("a").alias("act"), F.col("b").alias("impl"), "sim"))


def ranked_matches(scores):
    w = W.partitionBy("conv_id", "act")
    return (
        scores.withColumn("best", F.max("sim").over(w))
        .withColumn("rank", F.row_number().over(w.orderBy(F.desc("sim"), "impl")))
        .where((F.col("best") >= FLOOR) & (F.col("sim") >= FLOOR))
    )


@register(
    "act_attribution",
    "E8 J33 D25",
    f"WITH {UNION_SQL} SELECT conv_id, act, impl, sim, combined, overall FROM sm JOIN cb USING (conv_id, impl) JOIN ov USING (conv_id)",
)
def act_attribution(spark, sf):
    """Each pair's similarity, that of the implementation to all acts together, and the story's distance."""
    counts = dv.story_counts(_turns(spark, sf))
    combined = dv.combined_similarity(counts).select(F.col("story").alias("conv_id"), F.col("b").alias("impl"), "combined")
    overall = dv.overall_distance(counts).withColumnRenamed("story", "conv_id")
    return act_scores(spark, sf, counts).join(combined, ["conv_id", "impl"]).join(overall, "conv_id").select("conv_id", "act", "impl", "sim", "combined", "overall")


@register(
    "act_best_matches",
    "J33 W9 D26",
    f"""WITH {ACT_SQL}, rk AS (SELECT *, max(sim) OVER (PARTITION BY conv_id, act) AS best, row_number() OVER (PARTITION BY conv_id, act ORDER BY sim DESC, impl) AS rank FROM sm WHERE sim > 0)
 SELECT conv_id, act, impl, sim, rank = 1 AS is_best FROM rk WHERE best >= {FLOOR} AND sim >= {FLOOR} AND (rank = 1 OR round(sim, 6) >= round(best - {MARGIN}, 6))""",
)
def act_best_matches(spark, sf):
    near = (F.col("rank") == 1) | (F.col("sim") >= F.round(F.col("best") - MARGIN, 6))
    return ranked_matches(act_scores(spark, sf)).where(near).select("conv_id", "act", "impl", "sim", (F.col("rank") == 1).alias("is_best"))


@register(
    "orphan_implementations",
    "J34",
    f"""WITH {ACT_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, act ORDER BY sim DESC, impl) AS rank FROM sm WHERE sim >= {FLOOR})
 SELECT c.conv_id, c.turn AS impl FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM rk WHERE rk.conv_id = c.conv_id AND rk.impl = c.turn AND rank = 1)""",
)
def orphan_implementations(spark, sf):
    best = ranked_matches(act_scores(spark, sf)).where("rank = 1").select("conv_id", "impl")
    impls = table_fn(spark, sf)("conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("impl"))
    return impls.join(best, ["conv_id", "impl"], "left_anti")


ACTION_SQL = f"""{ACT_SQL},
 rk AS (SELECT *, max(sim) OVER (PARTITION BY conv_id, act) AS best, row_number() OVER (PARTITION BY conv_id, act ORDER BY sim DESC, impl) AS rank FROM sm WHERE sim >= {FLOOR}),
 bm AS (SELECT conv_id, act, max(CASE WHEN rank = 1 THEN impl END) AS impl, max(best) AS sim, count(*) FILTER (rank > 1 AND round(sim, 6) >= round(best - {MARGIN}, 6)) AS runners FROM rk GROUP BY ALL),
 cdf AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nd AS (SELECT count(*) AS n FROM tn), av AS (SELECT avg(dl) AS avgdl FROM dl),
 fa AS (SELECT b.conv_id, b.act, tf.term, tf.n, dl.dl FROM bm b JOIN tf ON tf.conv_id = b.conv_id AND tf.turn = b.act JOIN dl ON dl.conv_id = tf.conv_id AND dl.turn = tf.turn),
 fb AS (SELECT b.conv_id, b.act, tf.term, tf.n, dl.dl FROM bm b JOIN tf ON tf.conv_id = b.conv_id AND tf.turn = b.impl JOIN dl ON dl.conv_id = tf.conv_id AND dl.turn = tf.turn),
 df AS (SELECT coalesce(fa.conv_id, fb.conv_id) AS conv_id, coalesce(fa.act, fb.act) AS act, coalesce(fa.term, fb.term) AS term,
   CASE WHEN fb.term IS NULL THEN 'missing' WHEN fa.term IS NULL THEN 'extra' ELSE 'covered' END AS bucket, coalesce(fa.n, fb.n) AS n, coalesce(fa.dl, fb.dl) AS dl
   FROM fa FULL JOIN fb ON fa.conv_id = fb.conv_id AND fa.act = fb.act AND fa.term = fb.term),
 dw AS (SELECT conv_id, act, bucket, term, round((ln((1.0 + nd.n) / (1.0 + cdf.df)) + 1) * df.n * 2.2 / (df.n + 1.2 * (0.25 + 0.75 * df.dl / avgdl)), 6) AS weight
   FROM df JOIN cdf USING (term), nd, av WHERE NOT regexp_matches(term, '^[0-9.,_-]*$')),
 dr AS (SELECT *, row_number() OVER (PARTITION BY conv_id, act, bucket ORDER BY weight DESC, term) AS r FROM dw)"""
MAX_TERMS = 8


def act_term_diffs(spark, sf):
    """(conv_id, act, bucket, term, weight): terms of the act and its best match by where they occur."""
    turns = table_fn(spark, sf)("conversations").where("role IN ('user', 'assistant')")
    tf = lx.term_counts(turns.withColumn("toks", tx.word_tokens(F.col("text"))), F.col("toks"), "conv_id", "turn")
    sized = tf.withColumn("dl", F.sum("n").over(W.partitionBy("conv_id", "turn")))
    df = lx.document_frequency(tf)
    lengths = tf.groupBy("conv_id", "turn").agg(F.sum("n").alias("dl"))
    avg_len = lengths.agg(F.avg("dl")).scalar()
    best = ranked_matches(act_scores(spark, sf)).where("rank = 1").select("conv_id", "act", "impl")
    # Both sides of a best match are stacked and grouped: no self-join on terms.
    sides = best.select("conv_id", "act", F.col("act").alias("turn"), F.lit(1).alias("left")).unionByName(
        best.select("conv_id", "act", F.col("impl").alias("turn"), F.lit(0).alias("left"))
    )
    rows = sides.join(sized, ["conv_id", "turn"])
    per_term = rows.groupBy("conv_id", "act", "term").agg(
        F.max("left").alias("in_act"),
        F.min("left").alias("only_act"),
        F.max_by(F.struct("n", "dl"), "left").alias("m"),
    )
    bucket = F.when(F.col("only_act") == 1, "missing").when(F.col("in_act") == 0, "extra").otherwise("covered")
    weight = lx.smoothed_idf(F.col("df"), lx.corpus_size(turns)) * lx.bm25_tf(F.col("m.n"), F.col("m.dl"), avg_len)
    kept = per_term.where(~tx.is_numeric_text(F.col("term"))).join(df, "term")
    ranked = kept.select("conv_id", "act", bucket.alias("bucket"), "term", F.round(weight, 6).alias("weight"))
    return dv.limited(ranked, MAX_TERMS, "conv_id", "act", "bucket")


@register("act_term_diffs", "E9", f"WITH {ACTION_SQL} SELECT conv_id, act, bucket, term, weight FROM dr WHERE r <= {MAX_TERMS}")
def act_term_diffs_query(spark, sf):
    return act_term_diffs(spark, sf)


@register(
    "act_drift_actions",
    "E10",
    f"""WITH {ACTION_SQL}, k AS (SELECT conv_id, act, count(*) FILTER (bucket = 'missing') AS missing, count(*) FILTER (bucket = 'extra') AS extra FROM dr WHERE r <= {MAX_TERMS} GROUP BY ALL)
 SELECT c.conv_id, c.turn AS act, CASE WHEN bm.sim IS NULL THEN 'MissingFromImpl' WHEN runners >= 1 THEN 'ConsolidateImpl' WHEN bm.sim < 0.3 AND coalesce(missing, 0) >= 3 THEN 'ExpandImpl'
   WHEN bm.sim >= 0.3 AND coalesce(extra, 0) >= coalesce(missing, 0) + 4 THEN 'PruneStray' ELSE 'Ok' END AS action
 FROM conversations c LEFT JOIN bm ON bm.conv_id = c.conv_id AND bm.act = c.turn LEFT JOIN k ON k.conv_id = c.conv_id AND k.act = c.turn WHERE role = 'user'""",
)
def act_drift_actions(spark, sf):
    ranked = ranked_matches(act_scores(spark, sf))
    near = (F.col("rank") > 1) & (F.col("sim") >= F.round(F.col("best") - MARGIN, 6))
    best = ranked.groupBy("conv_id", "act").agg(F.max("sim").alias("sim"), F.count_if(near).alias("runners"))
    terms = act_term_diffs(spark, sf).groupBy("conv_id", "act").agg(
        F.count_if(F.col("bucket") == "missing").alias("missing"), F.count_if(F.col("bucket") == "extra").alias("extra")
    )
    acts = table_fn(spark, sf)("conversations").where("role = 'user'").select("conv_id", F.col("turn").alias("act"))
    both = acts.join(best, ["conv_id", "act"], "left").join(terms, ["conv_id", "act"], "left").fillna(0, ["missing", "extra"])
    action = (
        F.when(F.col("sim").isNull(), "MissingFromImpl")
        .when(F.col("runners") >= 1, "ConsolidateImpl")
        .when((F.col("sim") < 0.3) & (F.col("missing") >= 3), "ExpandImpl")
        .when((F.col("sim") >= 0.3) & (F.col("extra") >= F.col("missing") + 4), "PruneStray")
        .otherwise("Ok")
    )
    return both.select("conv_id", "act", action.alias("action"))


# Snapshots: before = ids not ending in 9; after = ids not ending in 0, those ending in 5 edited.
SNAP_SQL = """
 old AS (SELECT doc_id AS id, source || '/' || doc_id % 10 AS page, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 9),
 new AS (SELECT doc_id AS id, source || '/' || doc_id % 10 AS page, sha256(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 0),
 ch AS (SELECT coalesce(old.id, new.id) AS id, coalesce(old.page, new.page) AS page, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'deleted' WHEN old.h = new.h THEN 'unchanged' ELSE 'modified' END AS change
   FROM old FULL JOIN new ON old.id = new.id)"""


def snapshots(spark, sf):
    docs = table_fn(spark, sf)("documents")
    edited = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    page = F.concat("source", F.lit("/"), F.col("doc_id") % 10)
    old = docs.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("id"), page.alias("page"), F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), page.alias("page"), F.sha2(edited, 256).alias("h"))
    return old, new


@register("change_partition", "E11 F16 D3", f"WITH {SNAP_SQL} SELECT id, change FROM ch")
def change_partition(spark, sf):
    from lexiloom.operators import changes as ch

    return ch.classify(*snapshots(spark, sf)).select("id", "change")


@register("stale_and_deleted_units", "E12 D23", f"WITH {SNAP_SQL} SELECT id, CASE WHEN change = 'deleted' THEN 'deleted' ELSE 'stale' END AS state FROM ch WHERE change <> 'unchanged'")
def stale_and_deleted_units(spark, sf):
    from lexiloom.operators import changes as ch

    return ch.stale_units(*snapshots(spark, sf))


@register(
    "page_source_changes",
    "E13 D31",
    f"""WITH {SNAP_SQL} SELECT page, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted,
 CASE WHEN count(*) FILTER (change = 'deleted') > 0 THEN 'review' ELSE 'update' END AS action FROM ch WHERE change <> 'unchanged' AND page IN (SELECT page FROM old) GROUP BY page""",
)
def page_source_changes(spark, sf):
    from lexiloom.operators import changes as ch

    old, new = snapshots(spark, sf)
    return ch.page_actions(ch.classify(old, new), old.select("page"))


@register(
    "review_reuse",
    "E14",
    f"""WITH {SNAP_SQL}, dec AS (SELECT id, h, CASE WHEN id % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS decision FROM old)
 SELECT new.id, coalesce(decision, 'pending') AS decision FROM new LEFT JOIN dec ON dec.id = new.id AND dec.h = new.h""",
)
def review_reuse(spark, sf):
    from lexiloom.operators import changes as ch

    old, new = snapshots(spark, sf)
    decided = old.select("id", "h", F.when(F.col("id") % 3 == 0, "accepted").otherwise("rejected").alias("decision"))
    return ch.reuse_decisions(new, decided)


LINT_SQL = f"""{SNAP_SQL},
 st AS (SELECT 'stale_source' AS "check", 'warning' AS severity, id::VARCHAR AS page FROM ch WHERE change = 'deleted'),
 em AS (SELECT 'empty_page', 'info', conv_id || '/' || turn FROM conversations WHERE length(regexp_replace(text, '\\s', '', 'g')) < 50),
 br AS (SELECT 'broken_link', 'error', l_orderkey::VARCHAR FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)),
 om AS (SELECT 'orphan_page', 'warning', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))"""


@register("empty_turns", "E15", "SELECT conv_id || '/' || turn AS id FROM conversations WHERE length(regexp_replace(text, '\\s', '', 'g')) < 50")
def empty_turns(spark, sf):
    from lexiloom.operators import lint

    turns = table_fn(spark, sf)("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return lint.empty_pages(turns)


@register(
    "lint_report",
    "E16 E15 G17 G18",
    f"WITH {LINT_SQL} SELECT * FROM st UNION ALL SELECT * FROM em UNION ALL SELECT * FROM br UNION ALL SELECT * FROM om",
)
def lint_report(spark, sf):
    from lexiloom.operators import changes as ch, lint

    t = table_fn(spark, sf)
    stale = ch.classify(*snapshots(spark, sf)).where("change = 'deleted'").select("id")
    links = t("lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("target"))
    broken = lint.broken_links(links, t("part").where("p_size <= 40").select(F.col("p_partkey").alias("target"))).select(F.col("page").alias("id"))
    orphan = lint.orphans(t("orders").select(F.col("o_orderkey").alias("id")), links.select(F.col("page").alias("id")))
    return lint.report(stale_source=(stale, "warning"), empty_page=(empty_turns(spark, sf), "info"), broken_link=(broken, "error"), orphan_page=(orphan, "warning"))


@register(
    "manifest_validity",
    "E17",
    f"""WITH {SNAP_SQL} SELECT coalesce(new.id, old.id) AS id, CASE WHEN new.id IS NULL THEN 'orphaned' WHEN old.id IS NULL THEN 'missing' WHEN old.h = new.h THEN 'valid' ELSE 'outdated' END AS state
 FROM old FULL JOIN new ON old.id = new.id""",
)
def manifest_validity(spark, sf):
    from lexiloom.operators import changes as ch

    old, new = snapshots(spark, sf)
    return ch.manifest_states(old, new)


@register(
    "source_fingerprint",
    "I5 F18",
    """SELECT source, sha256(count(*)::VARCHAR || '|' || sum(('0x' || substr(sha256(doc_id || '|' || sha256(text)), 1, 15))::BIGINT::HUGEINT)::VARCHAR) AS fingerprint FROM documents GROUP BY source""",
)
def source_fingerprint(spark, sf):
    docs = table_fn(spark, sf)("documents").select("source", F.concat_ws("|", "doc_id", F.sha2("text", 256)).alias("member"))
    return docs.groupBy("source").agg(hashing.set_digest(F.col("member")).alias("fingerprint"))


@register(
    "cross_reference_gaps",
    "J35",
    """WITH lk AS (SELECT DISTINCT page_id AS page, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS source FROM pages),
 sl AS (SELECT lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) AS slug, min(page_id) AS page FROM pages GROUP BY ALL),
 pl AS (SELECT DISTINCT lk.page, sl.page AS target FROM lk JOIN sl ON slug <> '' AND slug = lower(regexp_extract(source, '^/([A-Za-z]+)', 1))),
 p AS (SELECT a.page AS id1, b.page AS id2, count(*) AS shared FROM lk a JOIN lk b ON a.source = b.source AND a.page < b.page GROUP BY ALL)
 SELECT id1, id2, shared FROM p WHERE NOT EXISTS (SELECT 1 FROM pl WHERE (pl.page = id1 AND pl.target = id2) OR (pl.page = id2 AND pl.target = id1))""",
)
def cross_reference_gaps(spark, sf):
    """A link names a page by the first word of its title; of several such pages the first is meant."""
    from lexiloom.operators import lint
    from lexiloom.plans.graphs import page_links

    links = settle(page_links(spark, sf))
    slug = F.lower(F.regexp_extract("html", "<title>([A-Za-z]+)", 1))
    pages = table_fn(spark, sf)("pages").groupBy(slug.alias("slug")).agg(F.min("page_id").alias("named")).where("slug <> ''")
    meant = F.lower(F.regexp_extract("target", "^/([A-Za-z]+)", 1))
    resolved = links.withColumn("slug", meant).join(pages, "slug").select("page", F.col("named").alias("target"))
    return lint.missing_cross_references(links.withColumnRenamed("target", "source"), resolved, 20000)
