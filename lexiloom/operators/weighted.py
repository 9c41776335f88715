"""BM25 vectors of texts, made text by text.

A text stays in one task: its words are counted there, and counted anew in the second pass rather than
shuffled or stored. The first pass shuffles one row per word and task, for the document frequencies.
The most frequent words, a bounded number of them, then travel to all tasks; only a text's rarer words
become rows that meet the frequencies in a join, so no word of that join is in many texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiloom.functions import text as tx
from lexiloom.operators import blocks as bl, lexical as lx
from lexiloom.session import settle

#: Words that travel to all tasks, words counted before a task hands them on, texts per batch of rows.
FREQUENT, FLUSH_WORDS, TEXTS = 1 << 18, 1 << 19, 512
_IN_WORDS = re.compile(re.sub(r"\\x\{(..)\}", r"\\x\1", tx.WORD_PATTERN).replace("{2,}", ""))
#: Latin-1 bytes of words in ASCII lower case, blanks for all others.
_SPREAD = bytes(c if _IN_WORDS.match(chr(c)) else 0x20 for c in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    """``tx.word_tokens`` of a text in UTF-8, in Latin-1, which holds all characters of words."""
    spread = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_SPREAD)
    return [t for t in spread.split() if len(t) > 1]


def _lists(kind: pa.DataType, lists: list) -> pa.ListArray:
    """A column of lists, from arrays of the same kind."""
    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    flat = np.concatenate(lists) if lists and kind != pa.string() else [t.decode("latin-1") for x in lists for t in x]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """(id, text): texts of rows that repeat an id are one, on lines of their own."""
    repeated = settle(docs.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        return docs.select("id", "text")
    same = docs.join(repeated, "id", "left_semi").groupBy("id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return docs.select("id", "text").join(repeated, "id", "left_anti").unionByName(same)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df, total) rows of a task; those without a term count its texts with words and all their words."""
    df: Counter[bytes] = Counter()
    docs = total = 0

    def rows() -> pa.RecordBatch:
        columns = [*(t.decode("latin-1") for t in df), None], [*df.values(), docs], [0] * len(df) + [total]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["term", "df", "total"])

    for batch in batches:
        for text in batch["text"]:
            found = words(text.as_py()) if text.is_valid else ()
            docs, total = docs + bool(found), total + len(found)
            df.update(set(found))
            if len(df) >= FLUSH_WORDS:
                yield rows()
                df.clear()
                docs = total = 0
    yield rows()


def bm25_vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, pos, w): BM25 vectors of (id, text), scaled to length 1 over all words.

    Only the entries of ``terms`` (term, pos) are kept; texts without any are left out. Written once.
    """
    n_docs = docs.count()
    texts = one_row_per_id(docs).select("id", F.col("text").cast("binary").alias("text"))
    counts = texts.mapInArrow(_frequencies, "term string, df bigint, total bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    stats = settle(counts.join(terms, "term", "left"))
    own = stats.where("term IS NOT NULL")
    lengths = stats.where("term IS NULL").first()
    mean = lengths["total"] / lengths["df"] if lengths and lengths["df"] else 1.0
    sizes = own.groupBy("df").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("df")).toArrow()
    # The frequency from which words travel; all rarer ones, if too many share the next.
    kept = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), FREQUENT, "right"))
    cut = int(sizes["df"][kept - 1].as_py()) if kept else n_docs + 1
    found = own.where(F.col("df") >= cut).select("term", "df", F.coalesce("pos", F.lit(-1)).alias("pos")).toArrow()
    idf = np.log((1.0 + n_docs) / (1.0 + found["df"].to_numpy())) + 1.0
    frequent = docs.sparkSession.sparkContext.broadcast((found["term"].to_pylist(), idf, found["pos"].to_numpy()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, idf, spots = frequent.value
        place = {t.encode("latin-1"): n for n, t in enumerate(named)}.get
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            rows = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"]):
                n = Counter(words(text.as_py()) if text.is_valid else ())
                if not n:
                    continue
                at = np.fromiter(map(place, n, repeat(-1)), np.int64, len(n))
                times = np.fromiter(n.values(), float, len(n))
                tf = lx.bm25_tf(times, times.sum(), mean)
                known = at >= 0
                w, pos = idf[at[known]] * tf[known], spots[at[known]]
                held, every = pos >= 0, list(n)
                rows.append((key, float((w * w).sum()), pos[held], w[held], [every[k] for k in np.flatnonzero(~known)], tf[~known]))
            keys, squares, *lists = zip(*rows) if rows else [()] * 6
            kinds = pa.int64(), pa.float64(), pa.string(), pa.float64()
            columns = [pa.array(keys, pa.string()), pa.array(squares, pa.float64()), *(_lists(t, c) for t, c in zip(kinds, lists))]
            yield pa.record_batch(columns, names=["id", "square", "pos", "w", "rare", "tf"])

    made = settle(texts.mapInArrow(weigh, "id string, square double, pos array<bigint>, w array<double>, rare array<string>, tf array<double>"))
    rare = made.select("id", F.explode(F.arrays_zip(F.col("rare").alias("term"), F.col("tf").alias("tf"))).alias("x")).select("id", "x.term", "x.tf")
    rare = rare.join(own.where(F.col("df") < cut).select("term", "df", "pos"), "term")
    rare = rare.select("id", "pos", (lx.smoothed_idf(F.col("df"), F.lit(n_docs)) * F.col("tf")).alias("w"))
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "w"))
    rare = rare.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("more"), F.collect_list(entry).alias("e"))
    whole = made.select("id", "square", "pos", "w").join(rare, "id", "left").where(F.coalesce(F.size("pos") > 0, F.lit(False)) | F.coalesce(F.size("e") > 0, F.lit(False)))
    norm = F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0)))
    pos = F.concat("pos", F.coalesce("e.pos", F.array().cast("array<bigint>")))
    w = F.concat("w", F.coalesce("e.w", F.array().cast("array<double>")))
    return settle(whole.select("id", pos.alias("pos"), F.transform(w, lambda x: x / norm).alias("w")))


def bm25_pairs(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``blocks.best_pairs`` of the texts of side a with those of side b of (side, id, text), weighted as one corpus.

    Ids come back as ``side:id``.
    """
    keyed = docs.select("side", F.concat_ws(":", "side", F.col("id").cast("string")).alias("id"), "text")
    asked = keyed.where("side = 'a'").select(F.explode(tx.word_tokens(F.col("text"))).alias("term")).distinct()
    vectors = bm25_vectors(keyed.select("id", "text"), settle(asked.withColumn("pos", F.monotonically_increasing_id())))
    left, right = (vectors.where(F.col("id").startswith(side)) for side in ("a:", "b:"))
    return bl.best_of_vectors(right, left.withColumnRenamed("id", "qid"), k, threshold)
