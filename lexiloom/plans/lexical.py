"""Term statistics and similarity joins over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import lexical as lx, pairs as pr, vector_blocks as vb
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.registry import register, table_fn
from lexiloom.session import settle

T = 0.8


@register("term_frequency", "A1 D5", f"WITH {sp.tf()} SELECT id, term, n FROM tf")
def term_frequency(spark, sf):
    docs = table_fn(spark, sf)("documents").withColumnRenamed("doc_id", "id")
    return lx.term_counts(docs, tx.word_tokens(F.col("text")), "id")


@register("document_frequency", "A2 D6", f"WITH {sp.tf()} SELECT term, df FROM dfq")
def document_frequency(spark, sf):
    return lx.document_frequency(lx.corpus_tf(table_fn(spark, sf)("documents")), "copies")


@register(
    "tfidf_weights",
    "A3 D7",
    f"WITH {sp.tf()}, {sp.TFIDF_W}, {sp.REPS} SELECT wt.id, term, round(w, 6) AS w FROM wt JOIN reps ON id = rep_id",
)
def tfidf_weights(spark, sf):
    docs = table_fn(spark, sf)("documents")
    weights = lx.tfidf_weights(settle(lx.corpus_tf(docs)), lx.corpus_size(docs))
    return weights.select("id", "term", F.round("w", 6).alias("w"))


@register(
    "bm25_weights",
    "A4",
    f"WITH {sp.tf()}, {sp.BM25_W}, {sp.REPS} SELECT wt.id, term, round(w, 6) AS w FROM wt JOIN reps ON id = rep_id",
)
def bm25_weights(spark, sf):
    docs = table_fn(spark, sf)("documents")
    tf = settle(lx.corpus_tf(docs))
    weights = lx.bm25_weights(tf, lx.corpus_size(docs), lx.average_length(tf))
    return weights.select("id", "term", F.round("w", 6).alias("w"))


@register(
    "vector_norms",
    "A5 D8",
    f"WITH {sp.tf()}, {sp.TFIDF_W}, {sp.REPS} SELECT id, round(sqrt(sum(w * w)), 6) AS norm FROM wt JOIN reps ON id = rep_id GROUP BY id",
)
def vector_norms(spark, sf):
    docs = table_fn(spark, sf)("documents")
    norms = lx.vector_norms(lx.tfidf_weights(lx.corpus_tf(docs), lx.corpus_size(docs)))
    return norms.select("id", F.round("norm", 6).alias("norm"))


@register(
    "batch_build_stats",
    "A6",
    f"""WITH {sp.tf()} SELECT (SELECT n_docs FROM nd) AS documents, (SELECT count(*) FROM tok) AS tokens,
        (SELECT count(*) FROM tf) AS vector_terms, (SELECT count(*) FROM dfq) AS vocabulary""",
)
def batch_build_stats(spark, sf):
    docs = table_fn(spark, sf)("documents")
    tf = lx.corpus_tf(docs)
    per_term = tf.groupBy("term").agg(
        F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.sum("copies").alias("entries")
    )
    return per_term.agg(
        F.sum("tokens").alias("tokens"), F.sum("entries").alias("vector_terms"), F.count("term").alias("vocabulary")
    ).select(lx.corpus_size(docs).alias("documents"), "tokens", "vector_terms", "vocabulary")


@register(
    "pair_search_stats",
    "A7 D12",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.REPS},
 rw AS (SELECT wt.* FROM wt JOIN reps ON id = rep_id), rdf AS (SELECT term, count(*) AS k FROM rw GROUP BY term),
 nm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM rw GROUP BY ALL),
 dots AS (SELECT a.id AS id1, b.id AS id2, sum(a.w * b.w) AS d FROM rw a JOIN rw b ON a.term = b.term AND a.id < b.id GROUP BY ALL),
 s AS (SELECT round(least(d / (x.nrm * y.nrm), 1.0), 6) AS sim FROM dots JOIN nm x ON x.id = id1 JOIN nm y ON y.id = id2)
 SELECT (SELECT sum(k * (k - 1) // 2)::BIGINT FROM rdf) AS posting_hits, (SELECT count(*) FROM s WHERE sim >= {T}) AS outputs""",
)
def pair_search_stats(spark, sf):
    docs = table_fn(spark, sf)("documents")
    tf = settle(lx.corpus_tf(docs))
    hits = tf.groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    terms = vb.numbered_terms(lx.document_frequency(tf, "copies"))
    found = pr.similar_pairs(lx.tfidf_weights(tf, lx.corpus_size(docs), terms), "cosine", T, tf.count())
    # Posting hits follow from the list lengths; the lists are never joined in full.
    return hits.agg(F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("bigint")).alias("posting_hits")).select(
        "posting_hits", found.agg(F.count(F.lit(1))).scalar().alias("outputs")
    )


@register(
    "average_document_length",
    "A8",
    f"WITH {sp.tf()}, dl AS (SELECT id, sum(n) AS dl FROM tf GROUP BY ALL) SELECT round(coalesce(avg(dl), 1.0), 6) AS avg_len FROM dl",
)
def average_document_length(spark, sf):
    docs = table_fn(spark, sf)("documents").select(F.size(tx.word_tokens(F.col("text"))).alias("dl"))
    return docs.where("dl > 0").agg(F.round(F.coalesce(F.avg("dl"), F.lit(1.0)), 6).alias("avg_len"))


@register(
    "unique_token_count",
    "A21",
    f"WITH {sp.tf()} SELECT d.source AS source, count(DISTINCT term) AS terms FROM tf JOIN documents d ON d.doc_id = tf.id GROUP BY ALL",
)
def unique_token_count(spark, sf):
    docs = table_fn(spark, sf)("documents").select("source", F.explode(F.array_distinct(tx.word_tokens(F.col("text")))).alias("term"))
    return docs.distinct().groupBy("source").agg(F.count("term").alias("terms"))


@register(
    "cross_group_pair_count",
    "A22",
    """WITH c AS (SELECT source, count(*) AS k FROM documents GROUP BY source)
 SELECT greatest((sum(k) * sum(k) - sum(k * k)) // 2, 1)::BIGINT AS pairs FROM c""",
)
def cross_group_pair_count(spark, sf):
    return pr.cross_group_pair_count(table_fn(spark, sf)("documents"), "source")


def folded_pairs(docs, strategy, threshold=T):
    return pr.with_copies(pr.compare(docs, strategy, threshold), lx.copy_members(docs))


@register(
    "tfidf_near_duplicates",
    "J1 P4 D11",
    f"WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)} SELECT * FROM folded",
)
def tfidf_near_duplicates(spark, sf):
    return folded_pairs(table_fn(spark, sf)("documents"), "tfidf")


@register(
    "bm25_near_duplicates",
    "J2 J23",
    f"WITH {sp.tf()}, {sp.BM25_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)} SELECT * FROM folded",
)
def bm25_near_duplicates(spark, sf):
    return folded_pairs(table_fn(spark, sf)("documents"), "bm25")


@register(
    "jsd_near_duplicates",
    "J3 J23",
    f"WITH {sp.tf()}, {sp.JSD}, {sp.REPS}, {sp.folded('jsims', T)} SELECT * FROM folded",
)
def jsd_near_duplicates(spark, sf):
    return folded_pairs(table_fn(spark, sf)("documents"), "jsd")


FUSE = """CASE WHEN greatest(bm25, jsd) - least(bm25, jsd) <= 0.15 THEN least((bm25 + jsd) / 2.0 * 1.1, 1.0)
  ELSE (greatest(bm25, jsd) * 0.7 + least(bm25, jsd) * 0.3) * 0.85 END"""


@register(
    "hybrid_near_duplicates",
    "J22 J23",
    f"""WITH {sp.tf()}, {sp.BM25_W}, {sp.COSINE}, {sp.JSD}, {sp.REPS},
 fused AS (SELECT s.id1, s.id2, round({FUSE}, 6) AS sim FROM (
   SELECT b.id1, b.id2, b.sim AS bm25, coalesce(j.sim, 0.0) AS jsd FROM sims b LEFT JOIN jsims j ON b.id1 = j.id1 AND b.id2 = j.id2
   WHERE b.sim >= {T * 0.5}) s), {sp.folded('fused', T)} SELECT * FROM folded""",
)
def hybrid_near_duplicates(spark, sf):
    return folded_pairs(table_fn(spark, sf)("documents"), "hybrid")


@register(
    "cross_source_near_duplicates",
    "P1 D1",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)}
 SELECT a.source || ':' || a.doc_id AS file1, b.source || ':' || b.doc_id AS file2, sim
 FROM folded JOIN documents a ON a.doc_id = id1 JOIN documents b ON b.doc_id = id2 WHERE a.source <> b.source""",
)
def cross_source_near_duplicates(spark, sf):
    docs = table_fn(spark, sf)("documents")
    named = docs.select("doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("name"))
    pairs = (
        folded_pairs(docs, "tfidf")
        .join(named.select(F.col("doc_id").alias("id1"), F.col("name").alias("file1")), "id1")
        .join(named.select(F.col("doc_id").alias("id2"), F.col("name").alias("file2")), "id2")
    )
    return pr.cross_group(pairs, "file1", "file2").select("file1", "file2", "sim")


FDR_ALPHA = 0.05


@register(
    "false_discovery_filtered_pairs",
    "W10",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS},
 hit AS (SELECT * FROM sims WHERE sim >= {T}), m AS (SELECT n_docs * (n_docs - 1) / 2 AS m FROM nd),
 p AS (SELECT hit.*, greatest(least((SELECT count(*) FROM hit) / m.m * exp(-13.815510558 / (1.0 - {T}) * (sim - {T})), 1.0), 1e-15) AS p, m.m AS m FROM hit, m),
 rk AS (SELECT *, row_number() OVER (ORDER BY p) AS rn FROM p),
 cut AS (SELECT max(rn) AS k FROM rk WHERE p <= rn / m * {FDR_ALPHA}),
 kept AS (SELECT min(sim) AS cut_sim FROM rk, cut WHERE rn <= k), {sp.folded('sims', T)}
 SELECT id1, id2, sim FROM folded, kept WHERE sim >= cut_sim""",
)
def false_discovery_filtered_pairs(spark, sf):
    docs = table_fn(spark, sf)("documents")
    found = settle(pr.compare(docs, "tfidf", T))
    n = lx.corpus_size(docs)
    counts = pr.folded_counts(found, lx.copy_groups(docs))
    pairs = pr.with_copies(found, lx.copy_members(docs))
    return pr.false_discovery_filter(pairs, counts, FDR_ALPHA, n * (n - 1) / 2, T)


@register(
    "top_ranked_pairs",
    "K14 S7",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)}
 SELECT * FROM folded ORDER BY sim DESC, id1, id2 LIMIT 50""",
)
def top_ranked_pairs(spark, sf):
    return folded_pairs(table_fn(spark, sf)("documents"), "tfidf").orderBy(F.desc("sim"), "id1", "id2").limit(50)


TURNS = "(SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, text FROM conversations)"
PAIR_TF = f"""
 ab AS (SELECT conv_id || ':' || turn AS id, {sp.words('prev')} AS x, {sp.words('text')} AS y FROM {TURNS} WHERE prev IS NOT NULL),
 ta AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(x) AS term FROM ab) GROUP BY ALL),
 tb AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(y) AS term FROM ab) GROUP BY ALL),
 sz AS (SELECT id, len(x)::DOUBLE AS la, len(y)::DOUBLE AS lb FROM ab),
 j AS (SELECT coalesce(ta.id, tb.id) AS id, ta.n AS na, tb.n AS nb FROM ta FULL JOIN tb ON ta.id = tb.id AND ta.term = tb.term)"""


def _turn_pairs(spark, sf):
    from pyspark.sql import Window as W

    turns = table_fn(spark, sf)("conversations")
    prev = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), prev.alias("a"), F.col("text").alias("b")
    ).where("a IS NOT NULL")


@register(
    "adjacent_turn_tfidf_distance",
    "J4",
    f"""WITH {PAIR_TF},
 w AS (SELECT id, coalesce(1 + ln(na), 0) * CASE WHEN na IS NULL OR nb IS NULL THEN ln(1.5) + 1 ELSE 1 END AS wa,
              coalesce(1 + ln(nb), 0) * CASE WHEN na IS NULL OR nb IS NULL THEN ln(1.5) + 1 ELSE 1 END AS wb FROM j),
 g AS (SELECT id, sum(wa * wb) AS d, sum(wa * wa) AS a2, sum(wb * wb) AS b2 FROM w GROUP BY id)
 SELECT sz.id, round(CASE WHEN la = 0 AND lb = 0 THEN 0.0 WHEN la = 0 OR lb = 0 THEN 1.0
     ELSE 1 - least(d / sqrt(a2 * b2), 1.0) END, 6) AS dist FROM sz LEFT JOIN g USING (id)""",
)
def adjacent_turn_tfidf_distance(spark, sf):
    from lexiloom.operators import pairwise as pw

    return pw.tfidf_distance(_turn_pairs(spark, sf), "id", "a", "b").select("id", F.round("dist", 6).alias("dist"))


@register(
    "adjacent_turn_bm25_similarity",
    "J5",
    f"""WITH {PAIR_TF},
 w AS (SELECT id, CASE WHEN na IS NULL OR nb IS NULL THEN ln(1.5) + 1 ELSE 1 END AS idf, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, la, lb,
   CASE WHEN la > 0 AND lb > 0 THEN (la + lb) / 2 ELSE greatest(la, lb) END AS av FROM j JOIN sz USING (id)),
 x AS (SELECT id, idf * na * 2.2 / (na + 1.2 * (0.25 + 0.75 * la / av)) AS wa, idf * nb * 2.2 / (nb + 1.2 * (0.25 + 0.75 * lb / av)) AS wb FROM w),
 g AS (SELECT id, sum(wa * wb) AS d, sum(wa * wa) AS a2, sum(wb * wb) AS b2 FROM x GROUP BY id)
 SELECT sz.id, round(CASE WHEN la = 0 OR lb = 0 THEN 0.0 ELSE least(d / sqrt(a2 * b2), 1.0) END, 6) AS sim FROM sz LEFT JOIN g USING (id)""",
)
def adjacent_turn_bm25_similarity(spark, sf):
    from lexiloom.operators import pairwise as pw

    return pw.bm25_similarity(_turn_pairs(spark, sf), "id", "a", "b").select("id", F.round("sim", 6).alias("sim"))


@register(
    "adjacent_turn_jsd",
    "J6",
    f"""WITH {PAIR_TF},
 p AS (SELECT id, coalesce(na, 0) / la AS p, coalesce(nb, 0) / lb AS q FROM j JOIN sz USING (id) WHERE la > 0 AND lb > 0),
 g AS (SELECT id, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) AS d FROM p GROUP BY id)
 SELECT sz.id, round(CASE WHEN la = 0 AND lb = 0 THEN 0.0 WHEN la = 0 OR lb = 0 THEN 1.0 ELSE least(greatest(d, 0.0), 1.0) END, 6) AS jsd FROM sz LEFT JOIN g USING (id)""",
)
def adjacent_turn_jsd(spark, sf):
    from lexiloom.operators import pairwise as pw

    return pw.jsd_distance(_turn_pairs(spark, sf), "id", "a", "b").select("id", F.round("jsd", 6).alias("jsd"))
