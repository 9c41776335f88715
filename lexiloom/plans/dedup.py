"""MinHash, clusters, duplicate units, lines and blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lexiloom.functions import hashing, text as tx
from lexiloom.operators import components as cc, duplicates as du, lexical as lx, minhash as mh, pairs as pr
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.lexical import T, folded_pairs
from lexiloom.plans.registry import register, table_fn

LSH_T = 0.5
FNV_SQL = (
    "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ord(c)::BIGINT)),"
    " lambda h, c: (xor(h, c) * 16777619) & 4294967295) & 2147483647"
)
SIGS = f"""{sp.tf()},
 hv AS (SELECT term, {FNV_SQL} AS h FROM dfq),
 co AS (SELECT i, CASE WHEN (i * 1103515245 + 12345) & 2147483647 = 0 THEN 1 ELSE (i * 1103515245 + 12345) & 2147483647 END AS a,
        (i * 1664525 + 1013904223) & 2147483647 AS b FROM (SELECT unnest(range(128)) AS i)),
 sg AS (SELECT id, i, min((a * h + b) % 2147483647) AS v FROM tf JOIN hv USING (term), co GROUP BY ALL),
 sv AS (SELECT id, list(v ORDER BY i) AS sig FROM sg GROUP BY id),
 srep AS (SELECT min(id) AS rep_id, sig FROM sv GROUP BY sig)"""
BANDS = """
 bk AS (SELECT rep_id AS id, sig, b, sig[b * {rows} + 1 : b * {rows} + {rows}] AS bucket FROM srep, (SELECT unnest(range({bands})) AS b)),
 cand AS (SELECT DISTINCT x.id AS id1, y.id AS id2 FROM bk x JOIN bk y ON x.b = y.b AND x.bucket = y.bucket AND x.id < y.id)"""
B5 = BANDS.format(bands=25, rows=5)
EST = """
 est AS (SELECT id1, id2, len(list_filter(list_zip(x.sig, y.sig), lambda p: p[1] = p[2])) / 128.0::DOUBLE AS sim
         FROM cand JOIN srep x ON x.rep_id = id1 JOIN srep y ON y.rep_id = id2)"""


def _sigs(spark, sf):
    return mh.signatures(lx.corpus_tf(table_fn(spark, sf)("documents")))


@register("term_hashes", "F14", f"WITH {sp.tf()} SELECT term, {FNV_SQL} AS h FROM dfq")
def term_hashes(spark, sf):
    docs = table_fn(spark, sf)("documents")
    terms = docs.select(F.explode_outer(tx.word_tokens(F.col("text"))).alias("term")).where("term IS NOT NULL").distinct()
    return terms.select("term", hashing.fnv1a(F.col("term")).alias("h"))


@register(
    "minhash_signatures",
    "J7 F15 D9",
    f"WITH {SIGS}, {sp.REPS} SELECT id, i::INT AS i, v FROM sg JOIN reps ON rep_id = id",
)
def minhash_signatures(spark, sf):
    return _sigs(spark, sf).select("id", F.posexplode("sig").alias("i", "v"))


@register(
    "lsh_candidate_pairs",
    "J10 J9 D10",
    f"""WITH {SIGS}, {B5} SELECT * FROM cand
 UNION ALL SELECT rep_id, id FROM sv JOIN srep USING (sig) JOIN (SELECT min(doc_id) AS first_id FROM documents GROUP BY text) ON first_id = id WHERE id <> rep_id""",
)
def lsh_candidate_pairs(spark, sf):
    """Pairs of signatures that share a bucket, and each text with the first one of its signature."""
    sigs, members = mh.signature_groups(_sigs(spark, sf))
    same = members.where("id <> rep_id").select(F.col("rep_id").alias("id1"), F.col("id").alias("id2"))
    return mh.candidate_pairs(sigs, *mh.band_parameters(LSH_T)).unionByName(same)


@register(
    "lsh_scored_pairs",
    "J11 J8",
    f"""WITH {SIGS}, {B5}, {EST} SELECT id1, id2, round(sim, 6) AS sim FROM est WHERE sim >= {LSH_T}
 UNION ALL SELECT rep_id, id, 1.0 FROM sv JOIN srep USING (sig) JOIN (SELECT min(doc_id) AS first_id FROM documents GROUP BY text) ON first_id = id WHERE id <> rep_id""",
)
def lsh_scored_pairs(spark, sf):
    sigs, members = mh.signature_groups(_sigs(spark, sf))
    return pr.with_copies(mh.scored_pairs(sigs, LSH_T), members).withColumn("sim", F.round("sim", 6))


def jaccard_score():
    """A user pair-scorer: Jaccard similarity of the word sets, over Arrow batches."""
    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            x, y = set(a), set(b)
            out.append(round(len(x & y) / len(x | y), 6) if x or y else 1.0)
        return pd.Series(out)

    return score


@register(
    "prefiltered_user_scores",
    "J12 U1 U2",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', LSH_T)},
 st AS (SELECT id, list(DISTINCT term) AS terms FROM tf GROUP BY id),
 sc AS (SELECT id1, id2, round(len(list_intersect(x.terms, y.terms)) / len(list_distinct(list_concat(x.terms, y.terms)))::DOUBLE, 6) AS sim
        FROM folded JOIN st x ON x.id = id1 JOIN st y ON y.id = id2)
 SELECT * FROM sc WHERE sim >= {2 * LSH_T - 0.2}""",
)
def prefiltered_user_scores(spark, sf):
    from lexiloom.operators import candidates as ca

    docs = table_fn(spark, sf)("documents")
    return ca.prefiltered_scores(docs, 2 * LSH_T, jaccard_score(), keep=2 * LSH_T - 0.2)


CLUSTER_SQL = f"""WITH RECURSIVE {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)},
 e AS (SELECT id1 AS a, id2 AS b FROM folded UNION SELECT id2, id1 FROM folded),
 reach AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other),
 lab AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""


@register("duplicate_clusters", "G1", CLUSTER_SQL + " SELECT id, component FROM lab")
def duplicate_clusters(spark, sf):
    return cc.connected_components(folded_pairs(table_fn(spark, sf)("documents"), "tfidf"))


@register("greedy_star_clusters", "G2")
def greedy_star_clusters(spark, sf):
    return cc.greedy_stars(folded_pairs(table_fn(spark, sf)("documents"), "tfidf"))


@register(
    "duplicate_units",
    "J17",
    f"""WITH {sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)},
 u AS (SELECT doc_id, lang AS name, source AS file, len(string_split(rtrim(text, chr(10)), chr(10))) AS k FROM documents)
 SELECT id1, id2, sim FROM folded JOIN u a ON a.doc_id = id1 JOIN u b ON b.doc_id = id2
 WHERE a.k >= 5 AND b.k >= 5 AND NOT (a.name = b.name AND a.file = b.file)""",
)
def duplicate_units(spark, sf):
    docs = table_fn(spark, sf)("documents")
    k = F.size(F.split(F.regexp_replace("text", "\n+$", ""), "\n"))
    units = docs.select("doc_id", F.col("lang").alias("name"), F.col("source").alias("file")).where(k >= 5)
    a = units.toDF("id1", "name1", "file1")
    b = units.toDF("id2", "name2", "file2")
    both = folded_pairs(docs, "tfidf").join(a, "id1").join(b, "id2")
    return both.where("NOT (name1 = name2 AND file1 = file2)").select("id1", "id2", "sim")


LINES_SQL = """
 ln0 AS (SELECT doc_id AS id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents),
 ln1 AS (SELECT id, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls)-1] ELSE ls END AS ls FROM ln0),
 ln AS (SELECT id, unnest(range(1, len(ls) + 1)) AS line_no, trim(unnest(ls), ' ' || chr(9) || chr(10) || chr(13)) AS line FROM ln1)"""


@register("text_lines", "F11 D14", f"WITH {LINES_SQL} SELECT id, line_no::INT AS line_no, line FROM ln")
def text_lines(spark, sf):
    return du.line_table(table_fn(spark, sf)("documents"))


MIN_BLOCK = 3
BLOCK_SQL = f"""{sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)}, {LINES_SQL},
 dg AS (SELECT DISTINCT id1, id2, a.line_no - b.line_no AS shift FROM folded JOIN ln a ON a.id = id1 JOIN ln b ON b.id = id2 AND a.line = b.line WHERE length(a.line) > 5),
 eq AS (SELECT id1, id2, shift, a.line_no AS i, length(a.line) AS sz FROM dg JOIN ln a ON a.id = id1 JOIN ln b ON b.id = id2 AND b.line_no = a.line_no - shift AND a.line = b.line),
 isl AS (SELECT *, i - row_number() OVER (PARTITION BY id1, id2, shift ORDER BY i) AS g FROM eq),
 runs AS (SELECT id1, id2, shift, g, min(CASE WHEN sz > 5 THEN i END) AS s, max(i) AS e FROM isl GROUP BY ALL),
 blocks AS (SELECT id1, id2, s AS start1, s - shift AS start2, e - s + 1 AS line_count FROM runs WHERE e - s + 1 >= {MIN_BLOCK})"""


@register("duplicate_line_blocks", "J18 W11", f"WITH {BLOCK_SQL} SELECT * FROM blocks")
def duplicate_line_blocks(spark, sf):
    docs = table_fn(spark, sf)("documents")
    return du.duplicate_blocks(folded_pairs(docs, "tfidf"), du.line_table(docs), MIN_BLOCK)


@register(
    "annotated_line_blocks",
    "J40",
    f"""WITH {BLOCK_SQL}, dc AS (SELECT id, line_no, regexp_extract(line, '^([A-Za-z]+)', 1) AS unit FROM ln WHERE regexp_matches(line, '^[A-Z][a-z]'))
 SELECT b.*, coalesce(x.unit, y.unit) AS unit FROM blocks b LEFT JOIN dc x ON x.id = id1 AND x.line_no = start1 LEFT JOIN dc y ON y.id = id2 AND y.line_no = start2""",
)
def annotated_line_blocks(spark, sf):
    docs = table_fn(spark, sf)("documents")
    lines = du.line_table(docs)
    declared = lines.where(F.col("line").rlike("^[A-Z][a-z]")).select(
        "id", "line_no", F.regexp_extract("line", "^([A-Za-z]+)", 1).alias("unit")
    )
    return du.annotate_blocks(du.duplicate_blocks(folded_pairs(docs, "tfidf"), lines, MIN_BLOCK), declared)


@register(
    "shared_literals",
    "A11",
    """WITH v AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS value FROM documents)
 SELECT value, count(DISTINCT id) AS files, count(*) AS uses, min(id) AS first_file FROM v GROUP BY value HAVING count(DISTINCT id) >= 2""",
)
def shared_literals(spark, sf):
    docs = table_fn(spark, sf)("documents")
    values = docs.select(F.col("doc_id").alias("id"), F.explode_outer(tx.matches(F.col("text"), "[0-9]{4,}")).alias("value"))
    return du.shared_literals(values.where("value IS NOT NULL"))


CROSS_SQL = f"""{sp.tf()}, {sp.TFIDF_W}, {sp.COSINE}, {sp.REPS}, {sp.folded('sims', T)},
 cm AS (SELECT id1, id2, sim, a.lang AS name1, b.lang AS name2, CASE WHEN a.n_chars = b.n_chars THEN 'path' ELSE 'content' END AS kind
        FROM folded JOIN documents a ON a.doc_id = id1 JOIN documents b ON b.doc_id = id2 WHERE a.source <> b.source)"""


def _cross_matches(spark, sf):
    docs = table_fn(spark, sf)("documents")
    a = docs.select("doc_id", "source", "n_chars", "lang").toDF("id1", "grp1", "rel1", "name1")
    b = docs.select("doc_id", "source", "n_chars", "lang").toDF("id2", "grp2", "rel2", "name2")
    both = folded_pairs(docs, "tfidf").join(a, "id1").join(b, "id2").where("grp1 <> grp2")
    kind = F.when(F.col("rel1") == F.col("rel2"), "path").otherwise("content")
    return both.withColumn("kind", kind)


@register("cross_group_match_kinds", "J19", f"WITH {CROSS_SQL} SELECT id1, id2, sim, kind FROM cm")
def cross_group_match_kinds(spark, sf):
    return _cross_matches(spark, sf).select("id1", "id2", "sim", "kind")


@register(
    "cross_group_name_pairs",
    "J20",
    f"WITH {CROSS_SQL} SELECT least(name1, name2) AS left_name, greatest(name1, name2) AS right_name, count(*) AS matches, max(sim) AS best FROM cm GROUP BY ALL",
)
def cross_group_name_pairs(spark, sf):
    return (
        _cross_matches(spark, sf)
        .groupBy(F.least("name1", "name2").alias("left_name"), F.greatest("name1", "name2").alias("right_name"))
        .agg(F.count(F.lit(1)).alias("matches"), F.max("sim").alias("best"))
    )


@register(
    "rule_categorised_documents",
    "J21 S3",
    """WITH r(rule_no, rx, target) AS (VALUES (1, '^src1[^/]*/en/', 'core'), (2, '^src[^/]*/fr/', 'french'), (3, '^src[0-4]/', 'early')),
 d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents),
 m AS (SELECT doc_id, min(rule_no) AS rule_no FROM d JOIN r ON regexp_matches(path, rx) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(r.target, 'unmatched') AS target FROM d LEFT JOIN m USING (doc_id) LEFT JOIN r USING (rule_no)""",
)
def rule_categorised_documents(spark, sf):
    from lexiloom.sources import paths as pa

    docs = table_fn(spark, sf)("documents")
    named = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    rules = [("src1*/en/**", "core"), ("src*/fr/**", "french"), ("src[0-4]/**", "early")]
    return named.select("doc_id", pa.first_rule(F.col("path"), rules, "unmatched").alias("target"))
