"""Sentences, windows, segments and sections."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lexiloom.operators import segments as sg, structure as st
from lexiloom.plans import sqlparts as sp
from lexiloom.plans.registry import register, table_fn

PIECES = "regexp_extract_all(text, '(?:[^.!?。！？．\n「『]+|「[^」\n]{0,238}」|『[^』\n]{0,238}』|[「『])*(?:[.!?。！？．]+|\n)|(?:[^.!?。！？．\n「『]+|「[^」\n]{0,238}」|『[^』\n]{0,238}』|[「『])+')"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
SENT = f"""
 pc AS (SELECT doc_id AS id, {PIECES} AS ps FROM documents),
 pp AS (SELECT id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS piece FROM pc),
 pe AS (SELECT *, sum(length(piece)) OVER (PARTITION BY id ORDER BY p)::BIGINT AS "end" FROM pp),
 sents AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) AS sent_no, {TRIM.format('piece')} AS text, "end" - length(piece) AS start, "end" FROM pe WHERE {TRIM.format('piece')} <> '')"""
WINS = SENT + """,
 w0 AS (SELECT id, sent_no AS win, list(text) OVER x AS ts, max("end") OVER x AS end_pos, count(*) OVER x AS held FROM sents
   WINDOW x AS (PARTITION BY id ORDER BY sent_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 wins AS (SELECT id, win, array_to_string(ts, ' ') AS text, end_pos FROM w0 WHERE held = 3 OR win = 1)"""
SERIES = WINS + f""",
 wt0 AS (SELECT id, win, unnest({sp.words('text')}) AS term FROM wins), wtf AS (SELECT id, win, term, count(*) AS n FROM wt0 GROUP BY ALL),
 wdf AS (SELECT id, term, count(*) AS df FROM wtf GROUP BY ALL), wn AS (SELECT id, count(*) AS k FROM wins GROUP BY id),
 ww AS (SELECT wtf.id, win, wtf.term, (1 + ln(n)) * (ln((1.0 + k) / (1.0 + df)) + 1) AS w FROM wtf JOIN wdf ON wdf.id = wtf.id AND wdf.term = wtf.term JOIN wn ON wn.id = wtf.id),
 wq AS (SELECT id, win, sum(w * w) AS sq FROM ww GROUP BY ALL),
 wd AS (SELECT a.id, a.win, sum(a.w * b.w) AS dot FROM ww a JOIN ww b ON a.id = b.id AND a.term = b.term AND b.win = a.win + 1 GROUP BY ALL),
 series AS (SELECT a.id, a.win, round(CASE WHEN coalesce(x.sq, 0) = 0 AND coalesce(y.sq, 0) = 0 THEN 0.0 WHEN coalesce(x.sq, 0) = 0 OR coalesce(y.sq, 0) = 0 THEN 1.0
    ELSE 1 - least(coalesce(dot, 0) / sqrt(x.sq * y.sq), 1.0) END, 6) AS value, a.end_pos
   FROM wins a JOIN wins b ON b.id = a.id AND b.win = a.win + 1 LEFT JOIN wq x ON x.id = a.id AND x.win = a.win LEFT JOIN wq y ON y.id = a.id AND y.win = a.win + 1 LEFT JOIN wd ON wd.id = a.id AND wd.win = a.win)"""


def _docs(spark, sf):
    return table_fn(spark, sf)("documents").select("doc_id", "text")


def _windows(spark, sf):
    return sg.sentence_windows(sg.sentences(_docs(spark, sf)))


def _series(spark, sf):
    return sg.text_series(_docs(spark, sf))


@register("sentences", "T1 D14", f"WITH {SENT} SELECT * FROM sents")
def sentences(spark, sf):
    return sg.sentences(_docs(spark, sf))


@register("sentence_counts", "T2", f'WITH {SENT} SELECT id, count(*) AS sentences, max("end") AS last_end FROM sents GROUP BY id')
def sentence_counts(spark, sf):
    return sg.sentences(_docs(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("sentences"), F.max("end").alias("last_end"))


@register("sentence_windows", "W1", f"WITH {WINS} SELECT * FROM wins")
def sentence_windows(spark, sf):
    return _windows(spark, sf)


@register("window_divergence", "W2 D16", f"WITH {SERIES} SELECT * FROM series")
def window_divergence(spark, sf):
    return _series(spark, sf)


@register("window_compression_distance", "W3 J14")
def window_compression_distance(spark, sf):
    return sg.adjacent_compression_distance(_windows(spark, sf)).withColumn("value", F.round("value", 6))


@register(
    "smoothed_divergence",
    "W4",
    f"WITH {SERIES} SELECT id, win, round(avg(value) OVER (PARTITION BY id ORDER BY win ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8) AS smooth FROM series",
)
def smoothed_divergence(spark, sf):
    return _series(spark, sf).select("id", "win", F.round(sg.moving_average("value", "id", "win"), 8).alias("smooth"))


@register(
    "divergence_peaks",
    "W5",
    f"""WITH {SERIES}, sm AS (SELECT id, win, value, round(avg(value) OVER (PARTITION BY id ORDER BY win ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 9) AS s, count(*) OVER (PARTITION BY id) AS n FROM series),
 nb AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY win) AS l, lead(s) OVER (PARTITION BY id ORDER BY win) AS r, min(s) OVER (PARTITION BY id) AS lo, max(s) OVER (PARTITION BY id) AS hi FROM sm),
 cd AS (SELECT * FROM nb WHERE n >= 3 AND s >= 0.45 AND (l IS NULL OR s >= l) AND (r IS NULL OR s >= r)),
 pr AS (SELECT cd.*, (SELECT max(x.win) FROM sm x WHERE x.id = cd.id AND x.win < cd.win AND x.s > cd.s) AS hl, (SELECT min(x.win) FROM sm x WHERE x.id = cd.id AND x.win > cd.win AND x.s > cd.s) AS hr FROM cd),
 cl AS (SELECT pr.*, (SELECT min(x.s) FROM sm x WHERE x.id = pr.id AND x.win <= pr.win AND x.win > coalesce(hl, 0)) AS cl, (SELECT min(x.s) FROM sm x WHERE x.id = pr.id AND x.win >= pr.win AND x.win < coalesce(hr, 1000000000)) AS cr FROM pr)
 SELECT id, win FROM cl WHERE round(s - greatest(CASE WHEN l IS NULL THEN cr ELSE cl END, CASE WHEN r IS NULL THEN cl ELSE cr END), 9) >= round(0.2 * (hi - lo), 9)
 UNION ALL SELECT id, win FROM sm WHERE n < 3 AND value >= 0.45""",
)
def divergence_peaks(spark, sf):
    return sg.local_maxima(_series(spark, sf), sg.TFIDF_THRESHOLD)


@register(
    "min_max_divergence",
    "A9",
    f"WITH {SERIES}, m AS (SELECT *, min(value) OVER (PARTITION BY id) AS lo, max(value) OVER (PARTITION BY id) AS hi FROM series) SELECT id, win, round(CASE WHEN hi - lo < 1e-10 THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM m",
)
def min_max_divergence(spark, sf):
    return _series(spark, sf).select("id", "win", F.round(sg.min_max(F.col("value"), "id"), 6).alias("scaled"))


@register(
    "robust_divergence",
    "A10",
    f"""WITH {SERIES}, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY id) AS med FROM series), d AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY id) AS mad FROM m),
 z AS (SELECT id, win, CASE WHEN mad < 1e-10 THEN 0.0 ELSE (value - med) / mad END AS z FROM d), k AS (SELECT *, min(z) OVER (PARTITION BY id) AS lo, max(z) OVER (PARTITION BY id) AS hi FROM z)
 SELECT id, win, round(CASE WHEN hi - lo < 1e-10 THEN 0.5 ELSE (z - lo) / (hi - lo) END, 6) AS scaled FROM k""",
)
def robust_divergence(spark, sf):
    return sg.robust_scaled(_series(spark, sf), "value", "id").select("id", "win", F.round("scaled", 6).alias("scaled"))


@register(
    "fused_divergence",
    "W6",
    f"""WITH {SERIES}, s2 AS (SELECT id, win, value, end_pos - coalesce(lag(end_pos) OVER (PARTITION BY id ORDER BY win), 0) AS step FROM series),
 rk AS (SELECT id, win, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY id ORDER BY value DESC, win)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY id ORDER BY step DESC, win)) AS f FROM s2),
 m AS (SELECT *, min(f) OVER (PARTITION BY id) AS lo, max(f) OVER (PARTITION BY id) AS hi FROM rk) SELECT id, win, round(CASE WHEN hi - lo < 1e-10 THEN 0.5 ELSE (f - lo) / (hi - lo) END, 6) AS fused FROM m""",
)
def fused_divergence(spark, sf):
    prev = F.coalesce(F.lag("end_pos").over(W.partitionBy("id").orderBy("win")), F.lit(0))
    series = _series(spark, sf).withColumn("step", F.col("end_pos") - prev)
    return sg.rank_fusion(series, ["value", "step"], "id", "win").select("id", "win", F.round("fused", 6).alias("fused"))


@register(
    "adaptive_thresholds",
    "W7",
    f"""WITH {SERIES}, r AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY value DESC) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY id) * 0.2::DOUBLE - 1), 0) AS p FROM series)
 SELECT id, greatest(value, 0.3) AS threshold FROM r WHERE i = p""",
)
def adaptive_thresholds(spark, sf):
    return sg.adaptive_threshold(_series(spark, sf), "value", "id", 0.2, 0.3)


@register(
    "knee_indexes",
    "F28",
    f"""WITH {SERIES}, r AS (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY value DESC) - 1 AS i, count(*) OVER (PARTITION BY id) AS n, min(value) OVER (PARTITION BY id) AS lo, max(value) OVER (PARTITION BY id) AS hi FROM series),
 s AS (SELECT id, n, lo, hi, i, round((value - lo) / nullif(hi - lo, 0) - (1 - i::DOUBLE / nullif(n - 1, 0)), 9) AS sag FROM r),
 g AS (SELECT id, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, min(sag) AS ms FROM s GROUP BY id),
 k AS (SELECT g.*, (SELECT min(i) FROM s WHERE s.id = g.id AND s.sag = g.ms) AS mi FROM g)
 SELECT id, (CASE WHEN n <= 1 THEN n WHEN n = 2 THEN CASE WHEN hi > 0 AND lo / hi <= 0.5 THEN 1 ELSE 2 END WHEN hi - lo <= 0 THEN n ELSE greatest(CASE WHEN ms < 0 THEN mi ELSE 0 END, 1) END)::BIGINT AS knee FROM k""",
)
def knee_indexes(spark, sf):
    return sg.knee_index(_series(spark, sf), "value", "id")


@register("punctuation_segments", "T3 T6 U3 D15")
def punctuation_segments(spark, sf):
    return sg.segment_by_punctuation(_docs(spark, sf))


@register("divergence_segments", "T5 T6 U3")
def divergence_segments(spark, sf):
    return sg.segment(_docs(spark, sf), "divergence")


@register("tfidf_segments", "T4 T6 U3")
def tfidf_segments(spark, sf):
    return sg.segment(_docs(spark, sf), "tfidf")


@register("adaptive_segments", "T5 T6 U3")
def adaptive_segments(spark, sf):
    return sg.segment(_docs(spark, sf), "adaptive")


@register("hybrid_segments", "T5 T6 U3 W6")
def hybrid_segments(spark, sf):
    return sg.segment(_docs(spark, sf), "hybrid")


@register("segment_texts", "T10 S8")
def segment_texts(spark, sf):
    docs = _docs(spark, sf)
    return sg.segment_texts(sg.segment_by_punctuation(docs), docs)


# A user turn is a heading; the turns up to the next one are its content.
SEC_SQL = f"""
 ln AS (SELECT conv_id AS id, turn AS line_no, text AS line, CASE WHEN role = 'user' THEN 1 END AS level FROM conversations),
 nm AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS section FROM ln),
 sc AS (SELECT id, section::BIGINT AS section, max(CASE WHEN level IS NOT NULL THEN line END) AS title, max(level) AS level, min(line_no) AS start_line, max(line_no) AS end_line,
   {TRIM.format("coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY line_no), '')")} AS content FROM nm WHERE section > 0 GROUP BY id, section),
 secs AS (SELECT * FROM sc WHERE content <> '')"""


def turn_lines(spark, sf):
    turns = table_fn(spark, sf)("conversations")
    return turns.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("line_no"), F.col("text").alias("line"), F.when(F.col("role") == "user", 1).alias("level")
    )


@register("document_sections", "T7", f"WITH {SEC_SQL} SELECT * FROM secs")
def document_sections(spark, sf):
    return st.sections(turn_lines(spark, sf))


@register(
    "document_fragments",
    "T8",
    f"""WITH {SEC_SQL}, f AS (SELECT id, line_no, last_value(CASE WHEN level IS NOT NULL THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading, line AS content, level FROM ln)
 SELECT id, line_no, heading, content, substr(sha256(id || '|' || line_no || '|' || content), 1, 32) AS fragment_id FROM f WHERE level IS NULL AND content <> ''""",
)
def document_fragments(spark, sf):
    return st.fragments(turn_lines(spark, sf))


@register(
    "numbered_acts",
    "T9",
    f"""WITH {SEC_SQL}, whole AS (SELECT conv_id AS id, coalesce(string_agg(text, chr(10) ORDER BY turn, text), '') AS content FROM conversations WHERE conv_id NOT IN (SELECT id FROM secs) GROUP BY conv_id)
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY section) AS act_no, title, content FROM secs UNION ALL SELECT id, 1, id::VARCHAR, content FROM whole""",
)
def numbered_acts(spark, sf):
    lines = turn_lines(spark, sf)
    return st.numbered_acts(st.sections(lines), lines)


SLUG = "translate(regexp_replace(translate({}, ' /', '--'), '[()&:*?\"<>|\\\\]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "page_proposals",
    "T11 F29 D30",
    f"""WITH {SEC_SQL}, whole AS (SELECT conv_id AS id, string_agg(text, chr(10)) AS text FROM conversations GROUP BY conv_id)
 SELECT id || '/' || {SLUG.format('title')} AS page_id, title, id AS source, length(content) AS chars FROM secs
 UNION ALL SELECT id::VARCHAR, id::VARCHAR, id, length(text) FROM whole WHERE id NOT IN (SELECT id FROM secs)""",
)
def page_proposals(spark, sf):
    # Turns are joined by line ends.
    chars = F.sum(F.char_length("text")) + F.count("text") - 1
    docs = table_fn(spark, sf)("conversations").groupBy(F.col("conv_id").alias("id")).agg(chars.alias("chars"))
    return st.page_proposals(st.sections(turn_lines(spark, sf)), docs)


@register(
    "facts_in_sections",
    "J39",
    f"WITH {SEC_SQL}, f AS (SELECT conv_id AS id, turn AS line, length(text) AS size FROM conversations WHERE role = 'assistant') SELECT f.id, line, size, section FROM f JOIN secs ON secs.id = f.id AND line BETWEEN start_line AND end_line",
)
def facts_in_sections(spark, sf):
    facts = table_fn(spark, sf)("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), F.col("turn").alias("line"), F.char_length("text").alias("size"))
    return st.facts_in_sections(facts, st.sections(turn_lines(spark, sf)))
