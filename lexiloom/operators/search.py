"""Vector and term search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import blocks as bl, lexical as lx
from lexiloom.session import settle


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths or a zero vector."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norms = [F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))) for v in (a, b)]
    scale = norms[0] * norms[1]
    return F.when((F.size(a) != F.size(b)) | (scale == 0), 0.0).otherwise(dot / scale)


def attribute_filter(spec: str) -> list[tuple[str, str]]:
    """'k:v,k2:v2' as (key, value) pairs; parts without a colon are ignored."""
    pairs = [part.split(":", 1) for part in spec.split(",") if ":" in part]
    return [(k.strip(), v.strip()) for k, v in pairs]


def matching(rows: DataFrame, spec: str, attrs: str | None = None) -> DataFrame:
    """Rows that satisfy every pair; attributes are columns or entries of a map column."""
    for key, value in attribute_filter(spec):
        col = F.col(attrs)[key] if attrs else F.col(key)
        rows = rows.where(col.cast("string").eqNullSafe(value))
    return rows


def best_first(rows: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows; each task keeps k, the merge sees k per task."""
    return rows.orderBy(F.desc(score), F.col(tie)).limit(k)


def best_per_group(rows: DataFrame, group: list[str], k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows per group. A rank filter is also applied before the shuffle, so at most k
    rows per group and task travel."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), F.col(tie)))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, query: list[float], k: int, vec: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors nearest to one query vector, which travels as a literal."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("score", F.round(dense_cosine(F.col(vec), wanted), 6))
    return best_first(scored.select("id", "score"), k)


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k nearest vectors (id, vec) of each query (qid, qvec) by cosine."""
    items = bl.unit(bl.dense_vectors(vectors, "id", "vec"))
    return bl.block_topk(items, bl.unit(bl.dense_vectors(queries, "qid", "qvec")), k)


def embed(tf: DataFrame, vocab: DataFrame, n_docs: Column) -> DataFrame:
    """(id, idx, w): L2-normalised TF-IDF vectors over a vocabulary, as sparse rows.

    The vocabulary is at most ``dim`` rows by construction, so it is broadcast.
    """
    rows = tf.join(F.broadcast(vocab.select("term", "df", "idx")), "term")
    rows = rows.withColumn("w", lx.sublinear_tf(F.col("n")) * lx.smoothed_idf(F.col("df"), n_docs))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return rows.select("id", "idx", (F.col("w") / norm).alias("w"))


def dense(sparse: DataFrame, dim: int) -> DataFrame:
    """(id, vec) arrays of length ``dim`` for storage."""
    entries = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("m"))
    spots = F.sequence(F.lit(0), F.lit(dim - 1))
    return entries.select("id", F.transform(spots, lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def sparse_search(sparse: DataFrame, queries: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k items that share a term with a query and are nearest to it.

    ``sparse`` and ``queries`` hold normalised rows (id, idx, w); with ``groups`` (id, group), the k of
    each group.
    """
    items = bl.sparse_vectors(sparse)
    if groups is not None:
        items = items.join(groups, "id")
    wanted = bl.sparse_vectors(queries).withColumnRenamed("id", "qid")
    return bl.block_topk(items, wanted, k, None if groups is None else next(c for c in groups.columns if c != "id"), 0.0)


class Provider(NamedTuple):
    """An index that answers queries: ``ask(queries)`` gives (qid, id, score, rank)."""

    name: str
    indexed: DataFrame
    dim: int
    ask: Callable[[DataFrame], DataFrame]


def cascade(providers: list[Provider], queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with provider, stats): each provider is asked only what the ones before left unanswered.

    ``queries`` has qid and what the providers read. Stats: (provider, indexed, dim, asked, answered, hits).
    """
    left, hits, stats = queries, [], []
    for p in providers:
        found = settle(p.ask(left).withColumn("provider", F.lit(p.name)))
        answered = found.select("qid").distinct()
        hits.append(found)
        one = p.indexed.agg(F.count(F.lit(1)).alias("indexed"))
        asked = left.agg(F.count(F.lit(1)).alias("asked"))
        got = found.agg(F.count_distinct("qid").alias("answered"), F.count(F.lit(1)).alias("hits"))
        # Three one-row results side by side.
        named = F.lit(p.name).alias("provider"), F.lit(p.dim).cast("bigint").alias("dim")
        stats.append(one.select(*named, "indexed", asked.scalar().alias("asked"), got.select("answered").scalar().alias("answered"), got.select("hits").scalar().alias("hits")))
        left = left.join(answered, "qid", "left_anti")
    return reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, stats)


def pattern_regex(pattern: str) -> str:
    """Regular expression over a 'Kind:text ' stream of a token pattern.

    Elements: Kind, Kind:text, "text", * (one token), ... (any number), !Kind (not that kind).
    """
    def quote(word: str) -> str:
        return "".join("\\" + c if c in r".^$+(){}|\[]*?-" else c for c in word)

    out = []
    for part in pattern.split():
        if part == "...":
            out.append(r"(?:[^ ]+ )*?")
        elif part == "*":
            out.append(r"[^ ]+ ")
        elif part.startswith("!"):
            out.append(rf"(?!{quote(part[1:])}:)[^ ]+ ")
        elif part.startswith('"'):
            out.append(rf"[^ :]+:{quote(part.strip(chr(34)))} ")
        elif ":" in part:
            out.append(rf"{quote(part)} ")
        else:
            out.append(rf"{quote(part)}:[^ ]* ")
    return r"(?:(?<= )|^)" + "".join(out)


def typed_stream(words: Column) -> Column:
    """Tokens as 'Kind:text ' in one string: Num for digits, Id for a separator or digit, else Word."""
    kind = lambda w: F.when(w.rlike("^[0-9]+$"), "Num").when(w.rlike("[-_0-9]"), "Id").otherwise("Word")
    return F.array_join(F.transform(words, lambda w: F.concat(kind(w), F.lit(":"), w, F.lit(" "))), "")


def pattern_matches(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, hit): every match of a token pattern. ``docs``: (id, text)."""
    stream = typed_stream(tx.word_tokens(F.col("text")))
    return docs.select("id", F.explode(tx.matches(stream, pattern_regex(pattern))).alias("hit"))


def owner_weights(present: DataFrame, n_owners: Column) -> DataFrame:
    """(term, weight): rarity of terms over owners. ``present``: (owner, term) distinct."""
    counts = present.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("term", lx.smoothed_idf(F.col("df"), n_owners).alias("weight"))


# Width and stride of the focus window.
FOCUS_WINDOW, FOCUS_STRIDE = 80, 24


def focus_scores(streams: DataFrame, tasks: DataFrame) -> DataFrame:
    """(qid, owner, focus): best share of a task's weight inside a hopping token window.

    ``streams``: (owner, pos from 0, term); ``tasks``: (qid, term, weight, total). Windows are laid over the
    streams once, for all tasks; they meet the tasks on terms.
    """
    first = F.greatest(F.ceil((F.col("pos") - (FOCUS_WINDOW - 1)) / FOCUS_STRIDE), F.lit(0))
    last = F.floor(F.col("pos") / FOCUS_STRIDE)
    spread = streams.where(first <= last).select("owner", "term", F.explode(F.sequence(first, last)).alias("win")).distinct()
    per_window = spread.join(tasks, "term").groupBy("qid", "owner", "win").agg(F.sum(F.col("weight") / F.col("total")).alias("got"))
    return per_window.groupBy("qid", "owner").agg(F.max("got").alias("focus"))


def term_ranking(presence: DataFrame) -> DataFrame:
    """(qid, term, owner_docs, consumer_docs): task terms without those that mostly consumers use.

    ``presence``: (qid, term, item, consumer) distinct.
    """
    counts = presence.groupBy("qid", "term").agg(
        F.count_if(~F.col("consumer")).alias("owner_docs"), F.count_if(F.col("consumer")).alias("consumer_docs")
    )
    dominated = (F.col("consumer_docs") >= 3) & (F.col("consumer_docs") > F.col("owner_docs"))
    return counts.where(~dominated)
