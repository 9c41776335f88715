"""Search over ``embeddings``, ``documents``, ``conversations`` and ``events``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W, functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import lexical as lx, search as se, tasks as tk
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.registry import register, table_fn
from lexiloom.session import settle

DIM = 256
COS = "list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform({b}::DOUBLE[], lambda x: x * x))))"
Q0 = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"


def _vectors(spark, sf):
    return table_fn(spark, sf)("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query_vector(spark, sf, vec_id=0):
    return _vectors(spark, sf).where(F.col("id") == vec_id).select("embedding").first()[0]


@register(
    "neighbour_cosine",
    "F19",
    f"SELECT a.vec_id AS id, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def neighbour_cosine(spark, sf):
    v = _vectors(spark, sf)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return v.join(nxt, "id").select("id", F.round(se.dense_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@register("vector_topk", "K3 D20 D21 D22", f"WITH {Q0} SELECT vec_id AS id, round({COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf):
    return se.vector_topk(_vectors(spark, sf), _query_vector(spark, sf), 10)


@register("filtered_vector_topk", "K5 P2", f"WITH {Q0} SELECT vec_id AS id, round({COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def filtered_vector_topk(spark, sf):
    return se.vector_topk(se.matching(_vectors(spark, sf), "label:3"), _query_vector(spark, sf), 10)


@register(
    "batch_vector_topk",
    "K4",
    f"""WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
 q AS (SELECT label::BIGINT AS qid, list(x ORDER BY i) AS qv FROM c GROUP BY label),
 s AS (SELECT qid, vec_id AS id, round({COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""",
)
def batch_vector_topk(spark, sf):
    # The queries are the mean vectors of the labels.
    v = _vectors(spark, sf)
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy(F.col("label").cast("bigint").alias("qid")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
    return se.batch_topk(v.select("id", F.col("embedding").alias("vec")), queries.select("qid", F.col("e.x").alias("qvec")), 5)


@register(
    "purpose_query",
    "P3 K8 K6 D20",
    f"""WITH {Q0}, t AS (SELECT vec_id AS id, label, round({COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings, q WHERE label IN (1, 3, 5) ORDER BY score DESC, id LIMIT 20)
 SELECT t.id, score, source FROM t JOIN documents d ON d.doc_id = t.id WHERE contains(source, '1') AND score >= 0.0""",
)
def purpose_query(spark, sf):
    # The kind filter precedes the top-k; module and score filters follow it, so fewer rows may remain.
    top = se.vector_topk(_vectors(spark, sf).where(F.col("label").isin(1, 3, 5)), _query_vector(spark, sf), 20)
    docs = table_fn(spark, sf)("documents").select(F.col("doc_id").alias("id"), "source")
    return top.join(docs, "id").where(F.contains("source", F.lit("1")) & (F.col("score") >= 0.0))


VOCAB = f"""
 vt AS (SELECT wt.term, df, sum(w) AS total FROM wt JOIN dfq USING (term) GROUP BY ALL),
 vocab AS (SELECT term, df, total, row_number() OVER (ORDER BY round(total, 6) DESC, term) - 1 AS idx FROM vt ORDER BY round(total, 6) DESC, term LIMIT {DIM})"""
EMB = """
 em0 AS (SELECT tf.id, idx, (1 + ln(n)) * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
 em AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM em0)"""


def _vocab(docs):
    tf = lx.corpus_tf(docs)
    n = lx.corpus_size(docs)
    return lx.vocabulary(lx.tfidf_weights(tf, n), DIM), n


@register("corpus_vocabulary", "A19 K2", f"WITH {sp.tf()}, {sp.TFIDF_W}, {VOCAB} SELECT term, df, round(total, 4) AS total, idx FROM vocab")
def corpus_vocabulary(spark, sf):
    vocab, _ = _vocab(table_fn(spark, sf)("documents"))
    return vocab.select("term", "df", F.round("total", 4).alias("total"), "idx")


@register("tfidf_embeddings", "K1 U4", f"WITH {sp.tf()}, {sp.TFIDF_W}, {VOCAB}, {EMB}, {sp.REPS} SELECT em.id, idx, round(w, 6) AS w FROM em JOIN reps ON rep_id = id")
def tfidf_embeddings(spark, sf):
    docs = table_fn(spark, sf)("documents")
    vocab, n = _vocab(docs)
    return se.embed(lx.corpus_tf(docs), vocab, n).select("id", "idx", F.round("w", 6).alias("w"))


BQ = f"""
 bt AS (SELECT item_id AS qid, unnest({sp.words('text')}) AS term FROM benchmark), btf AS (SELECT qid, term, count(*) AS n FROM bt GROUP BY ALL),
 bq0 AS (SELECT qid, idx, (1 + ln(n)) * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w FROM btf JOIN vocab USING (term), nd),
 bq AS (SELECT qid, idx, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM bq0),
 sc AS (SELECT qid, em.id, round(sum(em.w * bq.w), 6) AS score FROM em JOIN bq USING (idx) JOIN reps ON rep_id = em.id GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)"""
IX = f"WITH {sp.tf()}, {sp.TFIDF_W}, {VOCAB}, {EMB}, {sp.REPS}, {BQ}"


def index_search(spark, sf, k, groups=None):
    """(qid, id, score, rank): every benchmark item against the index of the documents."""
    docs = table_fn(spark, sf)("documents")
    tf, n = settle(lx.corpus_tf(docs)), lx.corpus_size(docs)
    vocab = lx.vocabulary(lx.tfidf_weights(tf, n), DIM)
    items = table_fn(spark, sf)("benchmark").select(F.col("item_id").alias("id"), tx.word_tokens(F.col("text")).alias("toks"))
    queries = se.embed(lx.term_counts(items, F.col("toks"), "id"), vocab, n)
    return se.sparse_search(se.embed(tf, vocab, n), queries, k, groups)


@register("index_search", "K7 K16", f"{IX} SELECT * FROM rk WHERE rank <= 20")
def index_search_query(spark, sf):
    return index_search(spark, sf, 20)


@register(
    "role_partitioned_search",
    "K10",
    f"{IX}, rr AS (SELECT qid, lang, id, score, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, id) AS rank FROM sc JOIN documents d ON d.doc_id = id) SELECT * FROM rr WHERE rank <= 3",
)
def role_partitioned_search(spark, sf):
    roles = table_fn(spark, sf)("documents").select(F.col("doc_id").alias("id"), "lang")
    return index_search(spark, sf, 3, roles)


@register(
    "owner_rollup",
    "K19 K10",
    f"""{IX}, h AS (SELECT rk.qid, d.source AS owner, score, id FROM rk JOIN documents d ON d.doc_id = id WHERE rank <= 20),
 o AS (SELECT qid, owner, max(score) AS best, count(*) AS paths, min(id) AS first_path FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best DESC, owner) AS rank FROM o)
 SELECT * FROM r WHERE rank <= 5""",
)
def owner_rollup(spark, sf):
    owners = table_fn(spark, sf)("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"))
    hits = index_search(spark, sf, 20).drop("rank").join(owners, "id")
    rolled = hits.groupBy("qid", "owner").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("paths"), F.min("id").alias("first_path"))
    return se.best_per_group(rolled, ["qid"], 5, "best", "owner")


# Benchmark items ask with their text first, with a stored vector if no document reaches CLEAR.
CLEAR = 0.5
CASCADE = f"""{IX}, p1 AS (SELECT qid, id, score, rank, 'terms' AS provider FROM rk WHERE rank <= 5 AND score >= {CLEAR}),
 ask AS (SELECT item_id AS qid, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id NOT IN (SELECT qid FROM p1)),
 cs AS (SELECT qid, vec_id AS id, round({COS.format(a='embedding', b='qv')}, 6) AS score FROM embeddings JOIN ask ON vec_id <> qid),
 p2 AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cs)"""


def cascade(spark, sf):
    """Two indexes behind one interface: term vectors of documents, then stored embeddings."""
    t = table_fn(spark, sf)
    docs, stored = t("documents"), t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    tf, n = settle(lx.corpus_tf(docs)), lx.corpus_size(docs)
    vocab = settle(lx.vocabulary(lx.tfidf_weights(tf, n), DIM))
    vectors = settle(se.embed(tf, vocab, n))

    def by_terms(queries):
        words = queries.select(F.col("qid").alias("id"), tx.word_tokens(F.col("text")).alias("toks"))
        asked = se.embed(lx.term_counts(words, F.col("toks"), "id"), vocab, n)
        return se.sparse_search(vectors, asked, 5).where(F.col("score") >= CLEAR)

    def by_vectors(queries):
        # One more than wanted, as a query's own vector is in the index too.
        known = queries.where("vec is not null").select("qid", F.col("vec").alias("qvec"))
        near = se.batch_topk(stored, known, 4).where("id <> qid")
        return se.best_per_group(near.drop("rank"), ["qid"], 3)

    items = t("benchmark").select(F.col("item_id").alias("qid"), "text")
    queries = items.join(stored.withColumnRenamed("id", "qid"), "qid", "left")
    dim = len(stored.first()["vec"])
    providers = [se.Provider("terms", vectors.select("id").distinct(), DIM, by_terms), se.Provider("vectors", stored, dim, by_vectors)]
    return se.cascade(providers, queries)


@register("provider_cascade", "K17", f"{CASCADE} SELECT * FROM p1 UNION ALL SELECT qid, id, score, rank, 'vectors' FROM p2 WHERE rank <= 3")
def provider_cascade(spark, sf):
    return cascade(spark, sf)[0]


@register(
    "provider_index_stats",
    "A18",
    f"""{CASCADE} SELECT 'terms' AS provider, {DIM}::BIGINT AS dim, (SELECT count(DISTINCT em.id) FROM em JOIN reps ON rep_id = em.id) AS indexed, (SELECT count(*) FROM benchmark) AS asked,
  (SELECT count(DISTINCT qid) FROM p1) AS answered, (SELECT count(*) FROM p1) AS hits
 UNION ALL SELECT 'vectors', (SELECT max(len(embedding)) FROM embeddings), (SELECT count(*) FROM embeddings),
  (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT qid FROM p1)), (SELECT count(DISTINCT qid) FROM p2), (SELECT count(*) FROM p2 WHERE rank <= 3)""",
)
def provider_index_stats(spark, sf):
    return cascade(spark, sf)[1]


TURN_TEXTS = "(SELECT conv_id || ':' || turn AS id, text FROM conversations)"
SEC_SEARCH = f"""WITH {sp.tf(TURN_TEXTS, 'id')}, {sp.TFIDF_W}, {VOCAB}, {EMB}, {BQ.replace(' JOIN reps ON rep_id = em.id', '')}"""


@register("section_search", "K9", f"{SEC_SEARCH} SELECT * FROM rk WHERE rank <= 10 AND score >= 0.05")
def section_search(spark, sf):
    secs = table_fn(spark, sf)("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    tf = settle(lx.term_counts(secs.withColumn("toks", tx.word_tokens(F.col("text"))), F.col("toks"), "id").withColumn("copies", F.lit(1)))
    n = lx.corpus_size(secs)
    vocab = lx.vocabulary(lx.tfidf_weights(tf, n), DIM)
    items = table_fn(spark, sf)("benchmark").select(F.col("item_id").alias("id"), tx.word_tokens(F.col("text")).alias("toks"))
    scored = se.sparse_search(se.embed(tf, vocab, n), se.embed(lx.term_counts(items, F.col("toks"), "id"), vocab, n), 10)
    return scored.where("score >= 0.05")


@register(
    "token_pattern_hits",
    "K15",
    f"""WITH t AS (SELECT doc_id AS id, unnest({sp.words('text')}) AS w, unnest(range(len({sp.words('text')}))) AS pos FROM documents),
 k AS (SELECT *, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 'Num' WHEN regexp_matches(w, '[-_0-9]') THEN 'Id' ELSE 'Word' END AS kind FROM t),
 n AS (SELECT id, pos, kind, w, lead(kind) OVER x AS k2, lead(w) OVER x AS w2, lead(kind, 2) OVER x AS k3 FROM k WINDOW x AS (PARTITION BY id ORDER BY pos))
 SELECT id, kind || ':' || w || ' ' || k2 || ':' || w2 || ' ' AS hit FROM n WHERE kind = 'Num' AND k2 = 'Word'""",
)
def token_pattern_hits(spark, sf):
    docs = table_fn(spark, sf)("documents").select(F.col("doc_id").alias("id"), "text")
    return se.pattern_matches(docs, "Num Word")


# Every benchmark item is a task; the ranking of owners is cut to a page of results per task.
TASK_HITS = 20


def _tasks(spark, sf):
    """(qid, term), distinct."""
    items = table_fn(spark, sf)("benchmark")
    return settle(items.select(F.col("item_id").alias("qid"), F.explode(tx.task_tokens(F.col("text"))).alias("term")).distinct())


CANON = "CASE WHEN length(t) > 5 AND regexp_matches(t, 'ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN length(t) > 5 AND regexp_matches(t, '(sses|ches|shes|xes|zes)$') THEN regexp_replace(t, 'es$', '') WHEN length(t) > 4 AND regexp_matches(t, '[^s]s$') THEN regexp_replace(t, 's$', '') ELSE t END"


def task_stream_sql(source, key):
    """CTEs: st(key, pos, term) canonical token stream of a table."""
    return f"""
 s1 AS (SELECT {key} AS k, {sp.words('text')} AS ws FROM {source}), s2 AS (SELECT k, unnest(range(len(ws))) AS p, unnest(ws) AS w FROM s1),
 s3 AS (SELECT k, p, 0 AS q, w AS t FROM s2 UNION ALL SELECT k, p, unnest(range(1, len(string_split_regex(w, '[-_]')) + 1)), unnest(string_split_regex(w, '[-_]')) FROM s2),
 st AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY p, q) - 1 AS pos, term FROM (SELECT k, p, q, {CANON} AS term FROM s3 WHERE t <> '') WHERE length(term) >= 2)"""


@register("task_tokens", "F7", f"WITH {task_stream_sql(TURN_TEXTS, 'id')} SELECT DISTINCT k AS id, term FROM st")
def task_tokens(spark, sf):
    turns = table_fn(spark, sf)("conversations")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.explode(tx.task_tokens(F.col("text"))).alias("term"))


TASK_SQL = f"""{task_stream_sql('documents', 'doc_id')}, {task_stream_sql('benchmark', 'item_id').replace('s1 ', 'q1 ').replace('s1)', 'q1)').replace('FROM s1', 'FROM q1').replace('s2', 'q2').replace('s3', 'q3').replace(' st AS', ' qst AS')},
 tt AS (SELECT DISTINCT k AS qid, term FROM qst), nt AS (SELECT qid, count(*) AS nt FROM tt GROUP BY qid), no AS (SELECT count(*) AS n FROM documents),
 pres AS (SELECT DISTINCT k, term FROM st WHERE term IN (SELECT term FROM tt)),
 ow AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS weight FROM pres, no GROUP BY term, n), tot AS (SELECT qid, sum(weight) AS total FROM tt JOIN ow USING (term) GROUP BY qid)"""
RANK_SQL = f"SELECT qid, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sx) WHERE rank <= {TASK_HITS}"


def _streams(spark, sf, tasks):
    """(owner, pos, term) of the documents' tokens that some task has."""
    docs = table_fn(spark, sf)("documents")
    streams = docs.select(F.col("doc_id").alias("owner"), F.posexplode(tx.task_token_stream(F.col("text"))).alias("pos", "term"))
    return settle(streams.join(tasks.select("term").distinct(), "term", "left_semi"))


def _asked(spark, sf, texts):
    """(qid, term, n, listed, share): words and task tokens of the tasks, with their share of the task's weight."""
    t = table_fn(spark, sf)
    words = lx.term_counts(t("benchmark").select(F.col("item_id").alias("qid"), tx.word_tokens(F.col("text")).alias("toks")), F.col("toks"), "qid")
    tasks = _tasks(spark, sf)
    held = texts.select(F.explode(F.array_distinct(F.split("stream", " "))).alias("term"))
    counts = held.join(tasks.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = settle(counts.select("term", lx.smoothed_idf(F.col("df"), lx.corpus_size(t("documents"))).alias("weight")))
    total = F.sum("weight").over(W.partitionBy("qid"))
    shares = tasks.join(weights, "term", "left").select("qid", "term", F.lit(1).alias("listed"), F.coalesce(F.col("weight") / total, F.lit(0.0)).alias("share"))
    return settle(words.join(shares, ["qid", "term"], "full_outer").fillna(0).fillna(0.0))


BM25_TASK = f"""
 b1 AS (SELECT item_id AS qid, unnest({sp.words('text')}) AS term FROM benchmark), b2 AS (SELECT qid, term, count(*) AS na FROM b1 GROUP BY ALL), bl AS (SELECT qid, sum(na)::DOUBLE AS la FROM b2 GROUP BY qid),
 d1 AS (SELECT doc_id AS k, unnest({sp.words('text')}) AS term FROM documents), d2 AS (SELECT k, term, count(*) AS nb FROM d1 GROUP BY ALL), dl AS (SELECT k, sum(nb)::DOUBLE AS lb FROM d2 GROUP BY k),
 jj AS (SELECT coalesce(x.qid, y.qid) AS qid, coalesce(x.k, y.k) AS k, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT qid, k, term, na FROM b2, dl) x FULL JOIN (SELECT qid, k, term, nb FROM d2, bl) y ON x.qid = y.qid AND x.k = y.k AND x.term = y.term),
 jw AS (SELECT qid, k, CASE WHEN na > 0 AND nb > 0 THEN 1 ELSE ln(1.5) + 1 END AS idf, na, nb, la, lb, (la + lb) / 2 AS av FROM jj JOIN dl USING (k) JOIN bl USING (qid)),
 jx AS (SELECT qid, k, idf * na * 2.2 / (na + 1.2 * (0.25 + 0.75 * la / av)) AS wa, idf * nb * 2.2 / (nb + 1.2 * (0.25 + 0.75 * lb / av)) AS wb FROM jw),
 bm AS (SELECT qid, k, least(sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)), 1.0) AS sim FROM jx GROUP BY ALL HAVING sum(wa * wb) > 0)"""


def _best_owners(spark, sf, score, words=True, focus=True):
    """The best documents of each task; texts are cut into tokens once, for the weights and the scores."""
    text = F.col("text")
    texts = settle(table_fn(spark, sf)("documents").select(
        F.col("doc_id").alias("owner"), (tk.joined(tx.word_tokens(text)) if words else F.lit(None).cast("string")).alias("words"),
        tk.joined(tx.task_token_stream(text)).alias("stream"),
    ))
    return tk.best_documents(texts, _asked(spark, sf, texts), score, TASK_HITS, focus)


@register(
    "task_relevance",
    "K11",
    f"""WITH {TASK_SQL}, {BM25_TASK}, ov AS (SELECT qid, k, count(*) AS c FROM pres JOIN tt USING (term) GROUP BY ALL),
 sx AS (SELECT coalesce(bm.qid, ov.qid) AS qid, coalesce(bm.k, ov.k) AS id, round(least(coalesce(c, 0) / nt::DOUBLE + 0.1 * coalesce(sim, 0), 1.0), 6) AS score FROM bm FULL JOIN ov ON ov.qid = bm.qid AND ov.k = bm.k JOIN nt ON nt.qid = coalesce(bm.qid, ov.qid)) {RANK_SQL}""",
)
def task_relevance(spark, sf):
    def score(sim, c, size, lex, focus):
        share = np.divide(c, size, out=np.zeros(len(c)), where=size > 0)
        return np.where(((c > 0) | (sim > 0)) & (size > 0), np.minimum(share + 0.1 * sim, 1.0), -np.inf)

    return _best_owners(spark, sf, score, focus=False)


FOCUS_SQL = """
 wn AS (SELECT DISTINCT k, term, unnest(range(greatest(ceil((pos - 79) / 24.0), 0)::BIGINT, pos // 24 + 1)) AS win FROM st WHERE term IN (SELECT term FROM tt)),
 fo AS (SELECT qid, k, max(got) AS focus FROM (SELECT qid, k, win, sum(weight / total) AS got FROM wn JOIN tt USING (term) JOIN ow USING (term) JOIN tot USING (qid) GROUP BY ALL) GROUP BY ALL)"""


@register("focus_windows", "W8", f"WITH {TASK_SQL}, {FOCUS_SQL}, sx AS (SELECT qid, k AS id, round(focus, 6) AS score FROM fo) {RANK_SQL}")
def focus_windows(spark, sf):
    def score(sim, c, size, lex, focus):
        return np.where(c > 0, focus, -np.inf)

    return _best_owners(spark, sf, score, words=False)


@register(
    "owner_relevance",
    "K12",
    f"""WITH {TASK_SQL}, {FOCUS_SQL}, {BM25_TASK}, lx AS (SELECT qid, k, sum(weight / total) AS lex FROM pres JOIN tt USING (term) JOIN ow USING (term) JOIN tot USING (qid) GROUP BY ALL),
 sx AS (SELECT qid, k AS id, round(least(lex * 0.3 + focus * 0.35 + sim * 0.35, 1.0), 6) AS score FROM lx JOIN fo USING (qid, k) JOIN bm USING (qid, k)) {RANK_SQL}""",
)
def owner_relevance(spark, sf):
    def score(sim, c, size, lex, focus):
        return np.where((c > 0) & (sim > 0), np.minimum(lex * 0.3 + focus * 0.35 + sim * 0.35, 1.0), -np.inf)

    return _best_owners(spark, sf, score)


@register(
    "task_term_ranking",
    "K13",
    f"""WITH {TASK_SQL}, c AS (SELECT qid, term, count(*) FILTER (lang = 'en') AS owner_docs, count(*) FILTER (lang <> 'en') AS consumer_docs FROM pres JOIN tt USING (term) JOIN documents ON doc_id = k GROUP BY ALL)
 SELECT qid, term, owner_docs, consumer_docs FROM c WHERE NOT (consumer_docs >= 3 AND consumer_docs > owner_docs)""",
)
def task_term_ranking(spark, sf):
    tasks = _tasks(spark, sf)
    kinds = table_fn(spark, sf)("documents").select(F.col("doc_id").alias("owner"), (F.col("lang") != "en").alias("consumer"))
    # Counted per term before the tasks are joined.
    present = _streams(spark, sf, tasks).select("owner", "term").distinct().join(kinds, "owner")
    ranked = se.term_ranking(present.select(F.lit(0).alias("qid"), "term", F.col("owner").alias("item"), "consumer")).drop("qid")
    return tasks.join(ranked, "term").select("qid", "term", "owner_docs", "consumer_docs")


@register(
    "recent_changes",
    "K18 S9 D32",
    """WITH l AS (SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50),
 r AS (SELECT user_id, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1 GROUP BY user_id)
 SELECT l.user_id, l.event_type, l.event_id FROM l JOIN r USING (event_id) ORDER BY l.ts DESC, l.event_id DESC LIMIT 20""",
)
def recent_changes(spark, sf):
    tail = table_fn(spark, sf)("events").select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    newest = tail.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    ordered = newest.orderBy(F.desc("m.ts"), F.desc("m.event_id")).limit(20)
    return ordered.select("user_id", F.col("m.event_type").alias("event_type"), F.col("m.event_id").alias("event_id"))


@register(
    "log_tail",
    "S9",
    "SELECT * FROM (SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY event_id",
)
def log_tail(spark, sf):
    tail = table_fn(spark, sf)("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return tail.select("event_id", "user_id", "event_type").orderBy("event_id")


@register(
    "unit_predicates",
    "P5 P6",
    """SELECT doc_id AS id FROM documents LEFT JOIN labels USING (doc_id)
 WHERE n_chars >= 200 AND n_chars <= 4000 AND contains(source, '1') AND quality IS NULL AND lower(lang) NOT IN ('fr', 'de')""",
)
def unit_predicates(spark, sf):
    t = table_fn(spark, sf)
    units = t("documents").select("doc_id", "n_chars", "source", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    keep = (
        F.col("n_chars").between(200, 4000)
        & F.contains("source", F.lit("1"))
        & F.col("quality").isNull()
        & ~F.lower("lang").isin("fr", "de")
    )
    return units.where(keep).select(F.col("doc_id").alias("id"))
