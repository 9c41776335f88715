"""Registered queries of the package: opN_<name> over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.plans.registry import table_fn

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_jaccard_join(spark, sf):
    from lexiloom.llm.ngram_join import jaccard_groups

    return jaccard_groups(table_fn(spark, sf)("documents"))


ORACLES["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
   WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, coalesce(l.k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) l ON l.a = d.doc_id"""


@query
def op2_bpe_encoding(spark, sf):
    import public_tokenizers

    from lexiloom.llm.bpe import digest_columns, encode_documents

    coded = encode_documents(table_fn(spark, sf)("documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", *digest_columns(F.col("ids"), F.col("decoded")))


@query
def op3_document_fingerprints(spark, sf):
    from lexiloom.llm.winnowing import fingerprints

    return fingerprints(table_fn(spark, sf)("documents")).drop("hashes", "positions")


@query
def op4_source_mixing(spark, sf):
    from lexiloom.llm.mixing import taken_words

    return taken_words(table_fn(spark, sf)("documents"))


@query
def op5_chat_formatting(spark, sf):
    from lexiloom.llm import chat

    given = table_fn(spark, sf)("conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    rows = given.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    made = chat.format_messages(rows)
    turns, masked = chat.read_turns(F.col("formatted")), chat.read_masked(F.col("formatted"), F.col("loss_spans"))
    made = made.select("conv_id", "formatted", turns.alias("turns"), masked.alias("masked"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLES["op5_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(length('<turn>' || replace(replace(role, '\', '\b'), '<', '\l') || '<say>' || x || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op6_substring_dedup(spark, sf):
    from lexiloom.llm.substring_dedup import repeated_passages

    return repeated_passages(table_fn(spark, sf)("documents"))


@query
def op7_toxicity(spark, sf):
    from lexiloom.llm.toxicity import toxic_documents

    table = table_fn(spark, sf)
    return toxic_documents(table("documents"), table("labels"))


@query
def op8_exact_topk(spark, sf):
    from lexiloom.llm.topk import top_k

    return top_k(table_fn(spark, sf)("embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op8_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS g FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.g, c.g), lambda p: p[1] * p[2]))::BIGINT AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op9_quality_classifier(spark, sf):
    from lexiloom.llm.quality import selected

    table = table_fn(spark, sf)
    return selected(table("documents").select("doc_id", "text"), table("labels")).select("doc_id", "quality_score.*")


@query
def op10_personal_data(spark, sf):
    from lexiloom.llm import pii

    found = pii.personal_data(table_fn(spark, sf)("documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.counted(F.col("pii_base"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
    )


@query
def op11_fill_in_middle(spark, sf):
    from lexiloom.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(table_fn(spark, sf)("documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
   WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS a, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
  array_to_string(u[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
 sha256(a || m || s) AS restored_sha256 FROM p"""


@query
def op13_collocations(spark, sf):
    from lexiloom.llm.collocations import collocations

    return collocations(table_fn(spark, sf)("documents"))


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM documents),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) v(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
nn AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
t AS MATERIALIZED (SELECT lang, phrase, a, unnest(range(1, k)) AS k, ws FROM c),
h AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS rest FROM t),
cuts AS (SELECT h.lang, h.phrase, h.a, h.k, x.a AS l, y.a AS r, (1000000::HUGEINT * h.a * h.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.rest),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
big AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, a AS longer, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
ranked AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN big ON big.lang = low.lang AND big.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, nn.n, o.score FROM ranked o JOIN nn ON nn.lang = o.lang WHERE o.rank <= 2000"""


@query
def op12_suffix_dedup(spark, sf):
    from lexiloom.llm.suffix_dedup import without_repeats

    cut = without_repeats(table_fn(spark, sf)("documents"), keep_first=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_suffix_dedup"] = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM b)),
g AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN g USING (m)),
n AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY ALL),
k AS (SELECT doc_id, run, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
j AS (SELECT b.doc_id, x, coalesce(string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') AS kept,
  coalesce(max(z), 0) AS z, coalesce(sum(z - a), 0) AS gone, count(a) AS n FROM b LEFT JOIN k ON k.doc_id = b.doc_id GROUP BY b.doc_id, x)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, n::BIGINT AS n_spans, sha256(unhex(kept || substr(x, 2 * z + 1))) AS kept_sha256 FROM j"""
