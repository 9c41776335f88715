"""SQL fragments shared by the SQL twins."""

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = "abcdefghijklmnopqrstuvwxyz"


def lower(col: str) -> str:
    return f"translate({col}, '{UP}', '{LOW}')"


def words(col: str) -> str:
    return f"regexp_extract_all({lower(col)}, '[a-z0-9_\\-\\x{{c0}}-\\x{{ff}}]{{2,}}')"


def tf(source: str = "documents", key: str = "doc_id", text: str = "text", prefix: str = "") -> str:
    """CTEs tok, tf, dfq, nd over a table."""
    p = prefix
    return f"""
 {p}tok AS (SELECT {key} AS id, unnest({words(text)}) AS term FROM {source}),
 {p}tf AS (SELECT id, term, count(*) AS n FROM {p}tok GROUP BY ALL),
 {p}dfq AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY ALL),
 {p}nd AS (SELECT count(*) AS n_docs FROM {source})"""


REPS = """
 reps AS (SELECT min(doc_id) AS rep_id, count(*) AS copies, text AS rep_text FROM documents GROUP BY text),
 members AS (SELECT d.doc_id AS id, r.rep_id FROM documents d JOIN reps r ON d.text = r.rep_text)"""

TFIDF_W = """
 wt AS (SELECT tf.id, tf.term, (1 + ln(n)) * (ln((1.0 + n_docs) / (1.0 + df)) + 1) AS w
        FROM tf JOIN dfq USING (term), nd)"""

BM25_W = """
 dl AS (SELECT id, sum(n) AS dl FROM tf GROUP BY ALL),
 av AS (SELECT avg(dl) AS avgdl FROM dl),
 wt AS (SELECT tf.id, tf.term, (ln((1.0 + n_docs) / (1.0 + df)) + 1)
               * (n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS w
        FROM tf JOIN dfq USING (term) JOIN dl USING (id), nd, av)"""

COSINE = """
 nm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM wt GROUP BY ALL),
 dots AS (SELECT a.id AS id1, b.id AS id2, sum(a.w * b.w) AS d
          FROM wt a JOIN wt b ON a.term = b.term AND a.id < b.id GROUP BY ALL),
 sims AS (SELECT id1, id2, round(least(d / (x.nrm * y.nrm), 1.0), 6) AS sim
          FROM dots JOIN nm x ON x.id = id1 JOIN nm y ON y.id = id2)"""

JSD = """
 pr AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS w FROM tf),
 jsims AS (SELECT a.id AS id1, b.id AS id2,
        round(least(greatest(sum(0.5 * (a.w * log2((a.w + b.w) / a.w) + b.w * log2((a.w + b.w) / b.w))), 0.0), 1.0), 6) AS sim
        FROM pr a JOIN pr b ON a.term = b.term AND a.id < b.id GROUP BY ALL)"""


def folded(source: str, threshold: float) -> str:
    """Representatives' pairs plus one row per copy, from a full pair listing."""
    return f"""
 folded AS (SELECT s.id1, s.id2, s.sim FROM {source} s
              JOIN reps r1 ON s.id1 = r1.rep_id JOIN reps r2 ON s.id2 = r2.rep_id WHERE s.sim >= {threshold}
            UNION ALL SELECT rep_id, id, 1.0 FROM members WHERE id <> rep_id)"""
