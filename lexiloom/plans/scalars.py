"""Scalar functions applied to whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lexiloom.functions import text as tx
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.registry import register, table_fn
from lexiloom.sources import paths as pa


def _documents(spark, sf):
    return table_fn(spark, sf)("documents")


NORM = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@register("normalized_text", "F1", f"SELECT doc_id, md5({NORM.format(sp.lower('text'))}) AS digest FROM documents")
def normalized_text(spark, sf):
    return _documents(spark, sf).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@register("word_tokens", "F2 D4", f"SELECT doc_id, len({sp.words('text')})::INT AS n, md5(array_to_string({sp.words('text')}, ' ')) AS digest FROM documents")
def word_tokens(spark, sf):
    words = tx.word_tokens(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@register(
    "character_bigrams",
    "F3 F4",
    f"""WITH p AS (SELECT doc_id, regexp_replace({sp.lower('text')}, '[ \\t\\n\\r]+', '', 'g') AS s FROM documents),
 b AS (SELECT doc_id, CASE WHEN length(s) = 0 THEN [] WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END AS g FROM p)
 SELECT doc_id, len(g)::INT AS n, md5(array_to_string(g, ' ')) AS digest FROM b""",
)
def character_bigrams(spark, sf):
    grams = tx.character_bigrams(F.col("text"))
    rows = _documents(spark, sf).select("doc_id", grams.alias("g"))
    return rows.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", " ")).alias("digest"))


LOWERED = "list_filter(list_transform(regexp_extract_all(text, '{}'), lambda w: {}), lambda w: length(w) >= {})"


@register(
    "vocabulary_words",
    "F5 F6",
    f"SELECT doc_id, len({LOWERED.format('[A-Za-z0-9_]+', sp.lower('w'), 3)})::INT AS vocab, len({LOWERED.format('[A-Za-z0-9]+', sp.lower('w'), 2)})::INT AS training, md5(array_to_string({LOWERED.format('[A-Za-z0-9_]+', sp.lower('w'), 3)}, ' ')) AS digest FROM documents",
)
def vocabulary_words(spark, sf):
    rows = _documents(spark, sf).select("doc_id", tx.vocabulary_words(F.col("text")).alias("v"), F.size(tx.training_words(F.col("text"))).alias("training"))
    return rows.select("doc_id", F.size("v").alias("vocab"), "training", F.md5(F.array_join("v", " ")).alias("digest"))


@register(
    "typed_features",
    "F8 F27 F29",
    """WITH f AS (SELECT p_partkey AS id, p_brand || ':' || p_type AS feature, 'src/' || p_brand || '/' || replace(p_name, ' ', '_') || '.' || p_size AS path FROM part)
 SELECT id, split_part(feature, ':', 1) AS kind, regexp_replace(feature, '^[^:]*:', '') AS value, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_extract(path, '(\\.[^.]+)$', 1) AS ext,
 regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]+$', '') AS stem, lower(translate(feature, ' /:', '--')) AS slug FROM f""",
)
def typed_features(spark, sf):
    part = table_fn(spark, sf)("part")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("."), F.col("p_size").cast("string"))
    rows = part.select(F.col("p_partkey").alias("id"), F.concat_ws(":", "p_brand", "p_type").alias("feature"), path.alias("path"))
    return rows.select(
        "id",
        tx.feature_kind(F.col("feature")).alias("kind"),
        tx.feature_value(F.col("feature")).alias("value"),
        tx.base_name(F.col("path")).alias("base"),
        tx.extension(F.col("path")).alias("ext"),
        tx.file_stem(F.col("path")).alias("stem"),
        tx.title_to_slug(F.col("feature")).alias("slug"),
    )


@register(
    "token_tests",
    "F9 F10",
    f"""WITH t AS (SELECT DISTINCT unnest({sp.words('text')}) AS w FROM documents)
 SELECT w, (NOT regexp_matches(w, '^[0-9]+$') AND (regexp_matches(w, '[-_.]') OR (length(w) < 5 AND regexp_matches(w, '[0-9]')) OR length(w) >= 5)) AS specific,
 regexp_matches(w, '^-?[0-9]+$') AS is_int, regexp_matches(w, '^[0-9.,_-]*$') AS is_numeric FROM t""",
)
def token_tests(spark, sf):
    words = _documents(spark, sf).select(F.explode(tx.word_tokens(F.col("text"))).alias("w")).distinct()
    w = F.col("w")
    return words.select("w", tx.is_specific_token(w).alias("specific"), tx.is_integer_text(w).alias("is_int"), tx.is_numeric_text(w).alias("is_numeric"))


@register(
    "joined_lists",
    "F12 F13",
    f"""WITH t AS (SELECT conv_id, turn, {sp.words('text')} AS ws, {sp.words("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS pw FROM conversations)
 SELECT conv_id, turn, array_to_string(ws[1:3], ', ') || CASE WHEN len(ws) > 3 THEN ' (+' || (len(ws) - 3) || ' more)' ELSE '' END AS shown, len(list_distinct(list_concat(ws, pw)))::INT AS merged FROM t""",
)
def joined_lists(spark, sf):
    prev = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    turns = table_fn(spark, sf)("conversations").select("conv_id", "turn", tx.word_tokens(F.col("text")).alias("ws"), tx.word_tokens(prev).alias("pw"))
    merged = tx.merge_unique(F.array_distinct("pw"), F.col("ws"))
    return turns.select("conv_id", "turn", tx.join_with_limit(F.col("ws"), 3).alias("shown"), F.size(merged).alias("merged"))


@register("content_hashes", "F16 F18", "SELECT doc_id, sha256(text) AS full_hash, substr(sha256(text), 1, 32) AS short_hash, sha256(source || '|' || lang) AS list_hash FROM documents")
def content_hashes(spark, sf):
    from lexiloom.functions import hashing

    return _documents(spark, sf).select(
        "doc_id",
        hashing.content_hash(F.col("text")).alias("full_hash"),
        hashing.short_hash(F.col("text")).alias("short_hash"),
        hashing.list_hash(F.array("source", "lang")).alias("list_hash"),
    )


# Requirement sentences made from orders, implementation notes made from line items.
REQ_SQL = """
 rq AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey || CASE o_orderstatus WHEN 'O' THEN ' shall ship' WHEN 'F' THEN ' must ship' ELSE ' may wait' END || ' under section ' || (o_custkey % 9 + 1) || '.' || (o_orderkey % 7)
   || ' and ' || (o_orderkey % 5 + 1) || ' with `' || o_orderpriority || '` of 4' || (o_custkey % 90 + 10) AS text FROM orders)"""


def requirement_texts(spark, sf):
    o = table_fn(spark, sf)("orders")
    verb = F.when(F.col("o_orderstatus") == "O", " shall ship").when(F.col("o_orderstatus") == "F", " must ship").otherwise(" may wait")

    def s(col):
        return col.cast("string")

    text = F.concat(
        F.lit("Order "), s(F.col("o_orderkey")), verb, F.lit(" under section "), s(F.col("o_custkey") % 9 + 1), F.lit("."), s(F.col("o_orderkey") % 7),
        F.lit(" and "), s(F.col("o_orderkey") % 5 + 1), F.lit(" with `"), "o_orderpriority", F.lit("` of 4"), s(F.col("o_custkey") % 90 + 10),
    )
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"))


@register(
    "requirement_features",
    "F21 F22 F23 F25",
    f"""WITH {REQ_SQL} SELECT id, CASE WHEN contains(upper(text), 'SHALL') THEN 'SHALL' WHEN contains(upper(text), 'MUST') THEN 'MUST' WHEN contains(upper(text), 'SHOULD') THEN 'SHOULD' ELSE 'NONE' END AS strength,
 regexp_extract(text, 'section ([0-9.]+) and', 1) || ',' || regexp_extract(text, ' and ([0-9]+) with', 1) AS refs, regexp_extract(text, '`([^`]+)`', 1) AS code,
 array_to_string(list_filter([CASE WHEN length(id::VARCHAR) >= 2 THEN id::VARCHAR END, CASE WHEN length(id::VARCHAR) < 2 OR regexp_extract(text, ' of ([0-9]+)', 1) <> id::VARCHAR THEN regexp_extract(text, ' of ([0-9]+)', 1) END, regexp_extract(text, '`([^`]+)`', 1)], lambda x: x IS NOT NULL), ',') AS literals FROM rq""",
)
def requirement_features(spark, sf):
    text = F.col("text")
    return requirement_texts(spark, sf).select(
        "id",
        tx.normative_strength(text).alias("strength"),
        F.array_join(tx.section_references(text), ",").alias("refs"),
        F.array_join(tx.inline_code(text), ",").alias("code"),
        F.array_join(tx.text_literals(text), ",").alias("literals"),
    )


@register(
    "literal_presence",
    "F23 F24",
    """SELECT l_orderkey, l_linenumber, (contains(lower(t), lower(a)) OR contains(lower(t), '0x' || lower(to_hex(a::BIGINT)))) AS present,
 CASE WHEN (contains(lower(t), lower(a)) OR contains(lower(t), '0x' || lower(to_hex(a::BIGINT)))) AND contains(t, b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS overlap
 FROM (SELECT l_orderkey, l_linenumber, 'part 0x' || lower(to_hex(l_partkey)) || ' from ' || l_suppkey AS t, (l_partkey + l_linenumber % 2)::VARCHAR AS a, l_suppkey::VARCHAR AS b FROM lineitem)""",
)
def literal_presence(spark, sf):
    line = table_fn(spark, sf)("lineitem")
    text = F.concat(F.lit("part 0x"), F.lower(F.hex("l_partkey")), F.lit(" from "), F.col("l_suppkey").cast("string"))
    rows = line.select("l_orderkey", "l_linenumber", text.alias("t"), (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        tx.literal_present(F.col("t"), F.col("a")).alias("present"),
        tx.literal_overlap(F.col("t"), F.array("a", "b")).alias("overlap"),
    )


@register(
    "identifier_scores",
    "F25 F26",
    """WITH n AS (SELECT p_partkey AS id, p_brand || '_' || replace(p_type, ' ', '-') AS name, p_name AS body, string_split(p_type, ' ') AS ids FROM part)
 SELECT id, lower(regexp_replace(translate(name, '_-', '  '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words,
 round(0.3 + 0.2 * len(list_filter(ids, lambda x: contains(lower(name), lower(x)) OR contains(lower(body), lower(x)))) / len(ids)::DOUBLE, 6) AS score FROM n""",
)
def identifier_scores(spark, sf):
    part = table_fn(spark, sf)("part")
    name = F.concat("p_brand", F.lit("_"), F.translate("p_type", " ", "-"))
    return part.select(
        F.col("p_partkey").alias("id"),
        tx.identifier_words(name).alias("words"),
        F.round(tx.identifier_match_score(name, F.col("p_name"), F.split("p_type", " ")), 6).alias("score"),
    )


@register(
    "shared_directories",
    "F31",
    """WITH p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents), j AS (SELECT a.doc_id, string_split(a.path, '/') AS x, string_split(b.path, '/') AS y FROM p a JOIN p b ON b.doc_id = a.doc_id + 1)
 SELECT doc_id, CASE WHEN x[1] <> y[1] THEN 'shared/utils/' WHEN x[2] <> y[2] THEN x[1] || '/utils/' ELSE x[1] || '/' || x[2] || '/utils/' END AS home FROM j""",
)
def shared_directories(spark, sf):
    docs = _documents(spark, sf).select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("other"))
    return docs.join(nxt, "doc_id").select("doc_id", tx.shared_directory(F.col("path"), F.col("other")).alias("home"))


@register(
    "wikilink_rewrites",
    "F30",
    "SELECT c_custkey AS id, '[' || c_mktsegment || '](wiki://' || c_name || ') and [' || c_name || '](wiki://' || c_name || ')' AS internal, '[[' || c_name || '|' || c_mktsegment || ']] and [[' || c_name || '|' || c_name || ']]' AS back, split_part(c_name, '#', 1) || ',' || split_part(c_name, '#', 1) AS targets FROM customer",
)
def wikilink_rewrites(spark, sf):
    cust = table_fn(spark, sf)("customer")
    text = F.concat(F.lit("[["), "c_name", F.lit("|"), "c_mktsegment", F.lit("]] and [["), "c_name", F.lit("]]"))
    rows = cust.select(F.col("c_custkey").alias("id"), tx.wikilinks_to_internal(text).alias("internal"))
    return rows.select("id", "internal", tx.internal_to_wikilinks(F.col("internal")).alias("back"), F.array_join(tx.wiki_link_targets(F.col("internal")), ",").alias("targets"))


@register(
    "path_filter",
    "S2 S3",
    """WITH p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)
 SELECT doc_id FROM p WHERE CASE WHEN regexp_matches(path, '^src3/.*$') THEN false WHEN regexp_matches(path, '^src1/[^/]*/[^/]*[.]txt$') THEN true
 WHEN regexp_matches(path, '^(.*/)?en/5[^/]*$') THEN true WHEN regexp_matches(path, '^(.*/)?en(/.*)?$') THEN false ELSE true END""",
)
def path_filter(spark, sf):
    docs = _documents(spark, sf).select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    keep = pa.should_include(F.col("path"), excludes=["src3/**"], includes=["src1/*/*.txt"], ignore_lines=["en/", "!en/5*"])
    return docs.where(keep).select("doc_id")
