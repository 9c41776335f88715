"""Sentences, window series and segmentation. Everything is independent per document."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from lexiloom.functions import text as tx
from lexiloom.operators import lexical as lx
from lexiloom.session import settle

# Sentence ends, quotes that protect them, and the longest protected quote.
TERMINATORS = ".!?。！？．"
QUOTED = "「[^」\n]{0,238}」|『[^』\n]{0,238}』"
QUOTE_OPENERS = "「『"
# Chunk sizes and window settings.
TARGET_SIZE, MIN_SIZE, MAX_SIZE = 500, 100, 2000
WINDOW = 3
TFIDF_THRESHOLD = 0.45
DIVERGENCE_THRESHOLD = 0.42
ADAPTIVE_SHARE, ADAPTIVE_FLOOR = 0.2, 0.13
PROMINENCE_SHARE = 0.2
RRF_K = 60

# Possessive quantifiers keep the walk linear where no terminator follows.
_BODY = f"(?:[^{TERMINATORS}\n{QUOTE_OPENERS}]++|{QUOTED}|[{QUOTE_OPENERS}])"
PIECE_PATTERN = f"{_BODY}*+(?:[{TERMINATORS}]++|\n)|{_BODY}++"


def pieces(text: Column) -> Column:
    """Consecutive sentence strings that cover the whole text; a short quote is never cut."""
    return tx.matches(text, PIECE_PATTERN)


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sent_no, text, start, end) with code point offsets; blank pieces are no sentences."""
    rows = docs.select(F.col(doc_id).alias("id"), F.posexplode_outer(pieces(F.col(text))).alias("p", "piece"))
    rows = rows.where("piece IS NOT NULL")
    doc = W.partitionBy("id").orderBy("p")
    placed = rows.withColumn("end", F.sum(F.char_length("piece")).over(doc))
    full = placed.where(tx.trim_blanks(F.col("piece")) != "")
    return full.select(
        "id",
        F.row_number().over(doc).alias("sent_no"),
        tx.trim_blanks(F.col("piece")).alias("text"),
        (F.col("end") - F.char_length("piece")).alias("start"),
        "end",
    )


def sentence_windows(sents: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, win, text, end_pos): ``size`` consecutive sentences; only whole windows, or the one short one."""
    doc = W.partitionBy("id").orderBy("sent_no")
    ahead = doc.rowsBetween(0, size - 1)
    rows = sents.select(
        "id",
        F.col("sent_no").alias("win"),
        F.array_join(F.collect_list("text").over(ahead), " ").alias("text"),
        F.max("end").over(ahead).alias("end_pos"),
        F.count(F.lit(1)).over(ahead).alias("held"),
    )
    return rows.where((F.col("held") == size) | (F.col("win") == 1)).drop("held")


def adjacent_tfidf_distance(windows: DataFrame) -> DataFrame:
    """(id, win, value, end_pos): TF-IDF distance of a window to the next, each document a corpus.

    Equal terms of neighbouring windows meet through lead() on (id, term): no self-join.
    """
    toks = windows.select("id", "win", tx.word_tokens(F.col("text")).alias("toks"))
    tf = lx.term_counts(toks, F.col("toks"), "id", "win")
    counts = windows.groupBy("id").agg(F.count(F.lit(1)).alias("n_win"))
    doc_term = W.partitionBy("id", "term")
    rows = tf.withColumn("df", F.count(F.lit(1)).over(doc_term)).join(counts, "id")
    rows = rows.withColumn("w", lx.sublinear_tf(F.col("n")) * lx.smoothed_idf(F.col("df"), F.col("n_win")))
    ahead = doc_term.orderBy("win")
    follows = F.lead("win").over(ahead) == F.col("win") + 1
    rows = rows.withColumn("part", F.when(follows, F.col("w") * F.lead("w").over(ahead)).otherwise(0.0))
    per_win = rows.groupBy("id", "win").agg(F.sum("part").alias("dot"), F.sum(F.col("w") * F.col("w")).alias("sq"))
    series = windows.select("id", "win", "end_pos").join(per_win, ["id", "win"], "left").fillna(0.0, ["dot", "sq"])
    doc = W.partitionBy("id").orderBy("win")
    paired = series.withColumn("next_sq", F.lead("sq").over(doc)).where("next_sq IS NOT NULL")
    value = (
        F.when((F.col("sq") == 0) & (F.col("next_sq") == 0), 0.0)
        .when((F.col("sq") == 0) | (F.col("next_sq") == 0), 1.0)
        .otherwise(1.0 - F.least(F.col("dot") / F.sqrt(F.col("sq") * F.col("next_sq")), F.lit(1.0)))
    )
    return paired.select("id", "win", F.round(value, 6).alias("value"), "end_pos")


def _text_divergence(words: str, size: int) -> np.ndarray:
    """TF-IDF distance of each window of ``size`` sentences to the next, the text being the corpus.

    ``words`` holds the tokens of a sentence per line. Every sentence is counted once per window it is in.
    """
    lines = [line.split() for line in words.split("\n")]
    k = len(lines) - size + 1
    if k < 2:
        return np.zeros(0)
    index: dict[str, int] = {}
    terms = np.array([index.setdefault(t, len(index)) for line in lines for t in line], np.int64)
    places = np.repeat(np.arange(len(lines)), [len(line) for line in lines])
    # Keys run by term, then window; one place is left free, so neighbours by 1 share their term.
    keys = np.concatenate([terms * (k + 1) + places - back for back in range(size)])
    held = np.concatenate([(places >= back) & (places - back < k) for back in range(size)])
    keys, counts = np.unique(keys[held], return_counts=True)
    term, win = keys // (k + 1), keys % (k + 1)
    df = np.bincount(term, minlength=len(index))
    weight = (1.0 + np.log(counts)) * (np.log((1.0 + k) / (1.0 + df[term])) + 1.0)
    square = np.bincount(win, weight * weight, k)
    follows = np.flatnonzero(np.diff(keys) == 1)
    dot = np.bincount(win[follows], weight[follows] * weight[follows + 1], k)[: k - 1]
    scale = np.sqrt(square[:-1] * square[1:])
    near = np.minimum(np.divide(dot, scale, out=np.zeros(k - 1), where=scale > 0), 1.0)
    return np.where((square[:-1] == 0) & (square[1:] == 0), 0.0, 1.0 - near)


def _divergence_udf(size: int):
    @F.pandas_udf(ArrayType(DoubleType()))
    def values(words: pd.Series) -> pd.Series:
        return pd.Series([_text_divergence(w, size) for w in words], dtype=object)

    return values


@F.pandas_udf(ArrayType(LongType()))
def _ends_udf(lens: pd.Series, kept: pd.Series) -> pd.Series:
    """Ends of the sentences among the consecutive pieces of a text."""
    return pd.Series([np.cumsum(n, dtype=np.int64)[np.asarray(k, bool)] for n, k in zip(lens, kept)], dtype=object)


def _sentence_words(text: Column) -> Column:
    return F.array_join(tx.word_tokens(text), " ")


def _valued(rows: DataFrame, size: int) -> DataFrame:
    """(id, win, value, end_pos) from (id, words, ends): one row per text, its sentences in order."""
    valued = rows.select("id", _divergence_udf(size)("words").alias("vals"), "ends")
    # A plain explode would put a filter with a second run of the whole chain below itself.
    series = valued.select("id", "ends", F.posexplode_outer("vals").alias("p", "v")).where("v IS NOT NULL")
    end = F.get("ends", F.col("p") + size - 1)
    return series.select("id", (F.col("p") + 1).alias("win"), F.round("v", 6).alias("value"), end.alias("end_pos"))


def sentence_series(sents: DataFrame, size: int = WINDOW) -> DataFrame:
    """As adjacent_tfidf_distance of the windows of sentences, each of which is moved and tokenised once."""
    held = F.struct("sent_no", F.col("end").cast("bigint").alias("end"), _sentence_words(F.col("text")).alias("words"))
    rows = sents.groupBy("id").agg(F.sort_array(F.collect_list(held)).alias("s"))
    return _valued(rows.select("id", F.array_join("s.words", "\n").alias("words"), F.col("s.end").alias("ends")), size)


def text_series(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same from whole texts with unique ids: narrow, no row per sentence and no shuffle."""
    cut = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), pieces(F.col(text)).alias("ps"))
    part = F.transform("ps", lambda p: F.struct(F.char_length(p).alias("len"), (tx.trim_blanks(p) != "").alias("full"), _sentence_words(p).alias("words")))
    parts = cut.select("id", part.alias("parts"))
    full = F.filter("parts", lambda p: p["full"])
    rows = parts.select("id", F.array_join(F.transform(full, lambda p: p["words"]), "\n").alias("words"), F.col("parts.len").alias("lens"), F.col("parts.full").alias("kept"))
    return _valued(rows.select("id", "words", _ends_udf("lens", "kept").alias("ends")), size)


def compressed_size(text: str) -> int:
    return len(zlib.compress(text.encode("utf-8"), 6))


@F.pandas_udf(DoubleType())
def compression_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Normalised compression distance of two texts."""
    out = []
    for a, b in zip(left, right):
        ca, cb = compressed_size(a), compressed_size(b)
        joint = compressed_size(a + b)
        out.append(min(max((joint - min(ca, cb)) / max(ca, cb), 0.0), 1.0) if a or b else 0.0)
    return pd.Series(out, dtype="float64")


def adjacent_compression_distance(windows: DataFrame) -> DataFrame:
    """(id, win, value, end_pos): compression distance of a window to the next."""
    doc = W.partitionBy("id").orderBy("win")
    paired = windows.withColumn("following", F.lead("text").over(doc)).where("following IS NOT NULL")
    return paired.select("id", "win", compression_distance("text", "following").alias("value"), "end_pos")


def moving_average(value: str, key: str, order: str, radius: int = 1) -> Column:
    return F.avg(value).over(W.partitionBy(key).orderBy(order).rowsBetween(-radius, radius))


def min_max(value: Column, key: str) -> Column:
    """Scaled to 0..1 per group; a constant group becomes 0.5."""
    group = W.partitionBy(key)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return F.when(high - low < 1e-10, 0.5).otherwise((value - low) / (high - low))


def robust_scaled(series: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``scaled``: distance from the median in median absolute deviations, then min-max."""
    group = W.partitionBy(key)
    rows = series.withColumn("_med", F.percentile(value, 0.5).over(group))
    rows = rows.withColumn("_mad", F.percentile(F.abs(F.col(value) - F.col("_med")), 0.5).over(group))
    z = F.when(F.col("_mad") < 1e-10, 0.0).otherwise((F.col(value) - F.col("_med")) / F.col("_mad"))
    return rows.withColumn("_z", z).withColumn("scaled", min_max(F.col("_z"), key)).drop("_med", "_mad", "_z")


def rank_fusion(series: DataFrame, signals: list[str], key: str, order: str, k: int = RRF_K) -> DataFrame:
    """Adds ``fused``: reciprocal ranks of the signals summed, then min-max per group."""
    total = F.lit(0.0)
    for s in signals:
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(s), F.col(order)))
        series = series.withColumn(f"_r_{s}", rank)
        total = total + 1.0 / (k + F.col(f"_r_{s}"))
    fused = series.withColumn("_rrf", total).withColumn("fused", min_max(F.col("_rrf"), key))
    return fused.drop("_rrf", *[f"_r_{s}" for s in signals])


def adaptive_threshold(series: DataFrame, value: str, key: str, share: float, floor: float) -> DataFrame:
    """(key, threshold): the value at place max(0, floor(n*share - 1)) in descending order, at least ``floor``."""
    group = W.partitionBy(key)
    rank = F.row_number().over(group.orderBy(F.desc(value)))
    place = F.greatest(F.floor(F.count(F.lit(1)).over(group) * share - 1), F.lit(0))
    rows = series.select(key, F.col(value).alias("_v"), (rank - 1).alias("_i"), place.alias("_p"))
    return rows.where("_i = _p").select(key, F.greatest("_v", F.lit(floor)).alias("threshold"))


def knee_index(series: DataFrame, value: str, key: str) -> DataFrame:
    """(key, knee): where a descending curve falls furthest below the straight line."""
    group = W.partitionBy(key)
    rows = series.select(
        key,
        F.col(value).alias("_v"),
        (F.row_number().over(group.orderBy(F.desc(value))) - 1).alias("_i"),
        F.count(F.lit(1)).over(group).alias("_n"),
        F.min(value).over(group).alias("_lo"),
        F.max(value).over(group).alias("_hi"),
    )
    sag = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) - (
        1.0 - F.col("_i") / F.nullif(F.col("_n") - 1, F.lit(0))
    )
    per = rows.withColumn("_sag", F.round(sag, 9)).groupBy(key).agg(
        F.first("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.min(F.struct("_sag", "_i")).alias("m")
    )
    two = F.when((F.col("hi") > 0) & (F.col("lo") / F.col("hi") <= 0.5), 1).otherwise(2)
    knee = (
        F.when(F.col("n") <= 1, F.col("n"))
        .when(F.col("n") == 2, two)
        .when(F.col("hi") - F.col("lo") <= 0, F.col("n"))
        .otherwise(F.greatest(F.when(F.col("m._sag") < 0, F.col("m._i")).otherwise(0), F.lit(1)))
    )
    return per.select(key, knee.cast("bigint").alias("knee"))


def peaks(values: Column, threshold: Column) -> Column:
    """Positions from 0 of the local maxima of the smoothed series that stand out by a fifth of its range.

    A series of less than three values is not smoothed: its values from the threshold on count.
    """
    n = F.size(values)
    last = n - 1

    def smoothed(v: Column, i: Column) -> Column:
        near = F.slice(values, F.greatest(i, F.lit(1)), F.when((i == 0) | (i == last), 2).otherwise(3))
        return F.round(F.aggregate(near, F.lit(0.0), lambda t, x: t + x) / F.size(near), 9)

    def stands_out(s: Column, i: Column) -> Column:
        own = F.get(s, i)
        positions = F.sequence(F.lit(0), last)
        left = F.coalesce(F.array_max(F.filter(positions, lambda j: (j < i) & (F.get(s, j) > own))), F.lit(-1))
        right = F.coalesce(F.array_min(F.filter(positions, lambda j: (j > i) & (F.get(s, j) > own))), n)
        low_left = F.when(i > 0, F.array_min(F.slice(s, left + 2, i - left)))
        low_right = F.when(i < last, F.array_min(F.slice(s, i + 1, right - i)))
        need = PROMINENCE_SHARE * (F.array_max(s) - F.array_min(s))
        return F.round(own - F.greatest(low_left, low_right), 9) >= F.round(need, 9)

    def maxima(s: Column) -> Column:
        inside = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (F.get(s, i) >= threshold)
            & ((i == 0) | (F.get(s, i) >= F.coalesce(F.get(s, i - 1), F.lit(0.0))))
            & ((i == last) | (F.get(s, i) >= F.coalesce(F.get(s, i + 1), F.lit(0.0)))),
        )
        return F.filter(inside, lambda i: stands_out(s, i))

    short = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.get(values, i) >= threshold)
    long = F.element_at(F.transform(F.array(F.transform(values, smoothed)), maxima), 1)
    return F.when(n == 0, F.array().cast("array<int>")).when(n < 3, short).otherwise(long)


def packed_series(series: DataFrame) -> DataFrame:
    """(id, wins, vals, spots): each series as arrays in order; no longer than its text has sentences."""
    packed = series.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("win", "value", "end_pos"))).alias("s"))
    return packed.select("id", F.col("s.win").alias("wins"), F.col("s.value").alias("vals"), F.col("s.end_pos").cast("array<bigint>").alias("spots"))


def local_maxima(series: DataFrame, threshold: float) -> DataFrame:
    """(id, win): the peaks of each document's series."""
    rows = packed_series(series.withColumn("end_pos", F.lit(0))).withColumn("p", F.explode(peaks(F.col("vals"), F.lit(threshold))))
    return rows.select("id", F.get("wins", F.col("p")).alias("win"))


NO_CUTS = "array<bigint>"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, inside folds where common parts are not shared."""
    return F.element_at(F.transform(F.array(value), use), 1)


def forced_cuts(start: Column, stop: Column, ends: Column, high: int, hard: bool) -> Column:
    """Cuts inside (start, stop) until no part exceeds ``high``: the sentence end nearest to the limit, or
    the limit itself where none is inside; without ``hard`` the rest stays long."""
    none = F.array().cast(NO_CUTS)
    tries = F.when(stop - start > high, F.sequence(F.lit(1), F.size(ends) + F.ceil((stop - start) / high).cast("int"))).otherwise(F.array().cast("array<int>"))

    def state(at: Column, cuts: Column, done: Column) -> Column:
        return F.struct(at.cast("bigint").alias("at"), cuts.cast(NO_CUTS).alias("cuts"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        goal = s["at"] + high
        near = F.array_min(F.transform(ends, lambda e: F.struct(F.abs(e - goal).alias("d"), e.alias("e"))))["e"]

        def cut(e: Column) -> Column:
            inside = (e > s["at"]) & (e < stop)
            other = state(goal, F.concat(s["cuts"], F.array(goal)), F.lit(False)) if hard else state(s["at"], s["cuts"], F.lit(True))
            return F.when(inside, state(e, F.concat(s["cuts"], F.array(e)), F.lit(False))).otherwise(other)

        return F.when(s["done"] | (stop - s["at"] <= high), s).otherwise(_once(F.coalesce(near, F.lit(-1).cast("bigint")), cut))

    return F.aggregate(tries, state(start, none, F.lit(False)), step, lambda s: s["cuts"])


def fitted_cuts(wanted: Column, ends: Column, length: Column, low: int, high: int, target: int) -> Column:
    """Cuts that respect the chunk sizes, by one ordered fold over the wanted positions: long spans are
    cut, short ones run on, a position counts from ``target`` on or close to ``high``."""
    def state(last: Column, cuts: Column) -> Column:
        return F.struct(last.cast("bigint").alias("last"), cuts.cast(NO_CUTS).alias("cuts"))

    def step(s: Column, pos: Column) -> Column:
        def placed(forced: Column) -> Column:
            last = F.when(F.size(forced) > 0, F.get(forced, F.size(forced) - 1)).otherwise(s["last"])
            size = pos - last
            taken = (size >= low) & ((size >= target) | (size > high * 0.8))
            cuts = F.concat(s["cuts"], forced)
            return F.when(taken, state(pos, F.concat(cuts, F.array(pos)))).otherwise(state(last, cuts))

        return _once(forced_cuts(s["last"], pos, ends, high, True), placed)

    start = state(F.lit(0), F.array().cast(NO_CUTS))
    return F.aggregate(F.sort_array(wanted), start, step, lambda s: F.concat(s["cuts"], forced_cuts(s["last"], length, ends, high, True)))


def spaced_cuts(wanted: Column, start: Column, low: int, stop: Column | None = None) -> Column:
    """Wanted positions at least ``low`` after the last one taken, and before ``stop`` if given."""
    def state(last: Column, cuts: Column) -> Column:
        return F.struct(last.cast("bigint").alias("last"), cuts.cast(NO_CUTS).alias("cuts"))

    def step(s: Column, pos: Column) -> Column:
        taken = pos - s["last"] >= low
        if stop is not None:
            taken = taken & (stop - pos >= low)
        return F.when(taken, state(pos, F.concat(s["cuts"], F.array(pos)))).otherwise(s)

    return F.aggregate(F.sort_array(wanted), state(start, F.array().cast(NO_CUTS)), step, lambda s: s["cuts"])


def few_sentence_cuts(ends: Column, length: Column, low: int, high: int, target: int) -> Column:
    """Cuts of a text with too few sentences for windows: a sentence end closes a chunk of at least
    ``target``; a rest under ``low`` joins the last chunk; a text up to ``high`` stays whole."""
    cuts = spaced_cuts(ends, F.lit(0), target)

    def joined(c: Column) -> Column:
        rest = length - F.get(c, F.size(c) - 1)
        return F.when((F.size(c) > 0) & (rest > 0) & (rest < low), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)

    return F.when(length <= high, F.array().cast(NO_CUTS)).otherwise(_once(cuts, joined))


def punctuation_edges(text: Column, low: int, high: int, target: int) -> Column:
    """The ascending edges of a text's chunks, by one ordered fold over its sentences.

    A sentence end closes a chunk of at least ``target``. A sentence that takes the chunk beyond ``high``
    closes it one end earlier than the last, if that leaves ``low``; what is still too long is cut every
    ``high`` code points. A short rest joins the last chunk, a blank one is left out.
    """
    parts = F.transform(pieces(text), lambda p: F.struct(F.char_length(p).alias("len"), (tx.trim_blanks(p) == "").alias("blank")))
    parts = F.concat(parts, F.array(F.struct(F.lit(0).alias("len"), F.lit(False).alias("blank"))))

    def state(pos, before, last, cuts):
        return F.struct(pos.alias("pos"), before.alias("before"), last.alias("last"), cuts.alias("cuts"))

    def step(s, part):
        end, start = s["pos"] + part["len"], F.element_at(s["cuts"], -1)
        base = F.when(s["before"] - start >= low, s["before"]).otherwise(start)
        cuts = (
            F.when(end - start > high, F.array_union(s["cuts"], F.sequence(base, end - 1, F.lit(high))))
            .when(end - start >= target, F.concat(s["cuts"], F.array(end)))
            .otherwise(s["cuts"])
        )
        real = ~part["blank"] & (end > s["last"])
        return F.when(real, state(end, s["last"], end, cuts)).otherwise(state(end, s["before"], s["last"], s["cuts"]))

    def finish(s):
        cuts, length = s["cuts"], F.array(s["pos"])
        rest = s["pos"] - F.element_at(cuts, -1)
        blank = tx.trim_blanks(F.substring(text, F.element_at(cuts, -1) + 1, rest)) == ""
        return (
            F.when(s["pos"] <= low, F.concat(F.array(F.lit(0)), length))
            .when(rest == 0, cuts)
            .when((rest < low) & (F.size(cuts) > 1), F.concat(F.slice(cuts, F.lit(1), F.size(cuts) - 1), length))
            .when(blank, cuts)
            .otherwise(F.concat(cuts, length))
        )

    return F.aggregate(parts, state(F.lit(0), F.lit(0), F.lit(0), F.array(F.lit(0))), step, finish)


def _segments(rows: DataFrame, cuts: Column) -> DataFrame:
    """(id, seg_no, start, end) from (id, length) and the cuts of each text."""
    inside = F.filter(F.array_distinct(cuts), lambda c: (c > 0) & (c < F.col("length")))
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.sort_array(inside), F.array(F.col("length").cast("bigint")))
    rows = rows.select("id", edges.alias("edges"))
    spans = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.element_at("edges", i).alias("a"), F.element_at("edges", i + 1).alias("b")))
    rows = rows.select("id", F.posexplode(spans).alias("p", "span"))
    return rows.select("id", (F.col("p") + 1).alias("seg_no"), F.col("span.a").cast("int").alias("start"), F.col("span.b").cast("int").alias("end"))


def segment_by_punctuation(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", target=TARGET_SIZE, low=MIN_SIZE, high=MAX_SIZE
) -> DataFrame:
    """(id, seg_no, start, end). Narrow and JVM-side; blank texts have no chunks."""
    rows = docs.where(tx.trim_blanks(F.col(text)) != "").select(
        F.col(doc_id).alias("id"), punctuation_edges(F.col(text), low, high, target).alias("edges")
    )
    spans = F.arrays_zip(F.col("edges").alias("a"), F.slice("edges", F.lit(2), F.size("edges") - 1).alias("b"))
    rows = rows.select("id", F.posexplode(spans).alias("p", "span")).where("span.b IS NOT NULL")
    return rows.select("id", (F.col("p") + 1).alias("seg_no"), F.col("span.a").alias("start"), F.col("span.b").alias("end"))


def _measured(docs: DataFrame, sents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, length, ends) of texts that are not blank: code points and the ends of their sentences."""
    ends = sents.groupBy("id").agg(F.sort_array(F.collect_list(F.col("end").cast("bigint"))).alias("ends"))
    sized = docs.where(tx.trim_blanks(F.col(text)) != "").select(F.col(doc_id).alias("id"), F.char_length(text).cast("bigint").alias("length"))
    return sized.join(ends, "id")


def _at_peaks(threshold: Column) -> Column:
    """Positions in the text of the peaks of a packed series."""
    found = F.transform(peaks(F.col("vals"), threshold), lambda p: F.get("spots", p))
    return F.coalesce(F.filter(found, lambda x: x > 0), F.array().cast(NO_CUTS))


def segment_by_series(
    docs: DataFrame, sents: DataFrame, series: DataFrame, threshold: float, window: int, doc_id="doc_id", text="text", low=MIN_SIZE, high=MAX_SIZE, target=TARGET_SIZE
) -> DataFrame:
    """(id, seg_no, start, end): cuts at the peaks of a (id, win, value, end_pos) series, fitted in size.

    Texts up to ``low`` stay whole, those with no more than ``window`` sentences are cut by size.
    """
    rows = settle(_measured(docs, sents, doc_id, text).join(packed_series(series), "id", "left"))
    length, ends = F.col("length"), F.col("ends")
    cuts = (
        F.when(length <= low, F.array().cast(NO_CUTS))
        .when(F.size(ends) <= window, few_sentence_cuts(ends, length, low, high, target))
        .otherwise(fitted_cuts(_at_peaks(F.lit(threshold)), ends, length, low, high, target))
    )
    return _segments(rows, cuts)


def refined_cuts(rows: DataFrame, sents: DataFrame, window: int, floor: float, low: int, high: int) -> DataFrame:
    """(id, cuts): the cuts of (id, length, ends, cuts) and those inside chunks beyond ``high``.

    The sentences of such a chunk are a corpus of their own: windows of half the size, and peaks from its
    median value on, or ``floor``. Cuts keep ``low`` on both sides; what is still too long is cut at
    sentence ends. All chunks of all texts are refined together.
    """
    edges = F.concat(F.array(F.lit(0).cast("bigint")), "cuts", F.array("length"))
    spans = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("a"), F.element_at(edges, i + 1).alias("b")))
    chunks = rows.select("id", "ends", F.explode(spans).alias("c")).select("id", "ends", "c.a", "c.b").where(F.col("b") - F.col("a") > high)
    chunks = settle(chunks)
    inside = sents.join(chunks.select("id", "a", "b"), "id").where("start >= a AND end <= b")
    part = F.struct("id", "a").alias("id")
    numbered = inside.select(part, F.row_number().over(W.partitionBy("id", "a").orderBy("sent_no")).alias("sent_no"), "text", "start", "end")
    half = max(window // 2, 1)
    enough = numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > half).select("id")
    series = packed_series(sentence_series(numbered.join(enough, "id", "left_semi"), half))
    middle = F.get(F.sort_array("vals", asc=False), F.floor(F.size("vals") / 2).cast("int"))
    keyed = chunks.join(series.select("id.id", "id.a", "vals", "spots"), ["id", "a"], "left")
    wanted = F.filter(_at_peaks(F.greatest(middle, F.lit(floor))), lambda p: (p > F.col("a")) & (p < F.col("b")))
    found = settle(keyed.select("id", "ends", "a", "b", spaced_cuts(wanted, F.col("a"), low, F.col("b")).alias("own")))
    last = F.coalesce(F.get("own", F.size("own") - 1), F.col("a"))
    more = found.select("id", F.concat("own", forced_cuts(last, F.col("b"), F.col("ends"), high, False)).alias("more"))
    added = more.groupBy("id").agg(F.flatten(F.collect_list("more")).alias("more"))
    every = F.sort_array(F.concat("cuts", F.coalesce("more", F.array().cast(NO_CUTS))))
    return rows.join(added, "id", "left").select("id", "length", every.alias("cuts"))


def segment_refined(
    docs: DataFrame, sents: DataFrame, series: DataFrame, share: float, floor: float, window: int, doc_id="doc_id", text="text", low=MIN_SIZE, high=MAX_SIZE, target=TARGET_SIZE
) -> DataFrame:
    """(id, seg_no, start, end): cuts at peaks over each text's own threshold, then refined chunks."""
    limits = adaptive_threshold(series, "value", "id", share, floor)
    rows = _measured(docs, sents, doc_id, text).join(packed_series(series), "id", "left").join(limits, "id", "left")
    length, ends, none = F.col("length"), F.col("ends"), F.array().cast(NO_CUTS)
    windowed = (length > low) & (F.size(ends) > window)
    cuts = F.when(windowed, spaced_cuts(_at_peaks(F.col("threshold")), F.lit(0), low)).otherwise(none)
    rows = settle(rows.select("id", "length", "ends", cuts.alias("cuts"), windowed.alias("windowed")))
    few = F.when(length <= low, none).otherwise(few_sentence_cuts(ends, length, low, high, target))
    fine = refined_cuts(rows.where("windowed").drop("windowed"), sents, window, floor, low, high)
    return _segments(rows.where("NOT windowed"), few).unionByName(_segments(fine, F.col("cuts")))


def segment_by_divergence(docs: DataFrame, threshold: float = DIVERGENCE_THRESHOLD, window: int = WINDOW, **sizes: int) -> DataFrame:
    """Cuts where the divergence of neighbouring windows peaks over a fixed threshold."""
    sents = settle(sentences(docs))
    return segment_by_series(docs, sents, text_series(docs, window), threshold, window, **sizes)


def segment_by_tfidf(docs: DataFrame, threshold: float = TFIDF_THRESHOLD, window: int = WINDOW, **sizes: int) -> DataFrame:
    """The same over robustly scaled divergence."""
    sents = settle(sentences(docs))
    series = text_series(docs, window)
    scaled = robust_scaled(series, "value", "id").select("id", "win", F.col("scaled").alias("value"), "end_pos")
    return segment_by_series(docs, sents, scaled, threshold, window, **sizes)


def segment_adaptive(docs: DataFrame, share: float = ADAPTIVE_SHARE, floor: float = ADAPTIVE_FLOOR, window: int = WINDOW, **sizes: int) -> DataFrame:
    """Window divergence with a threshold taken from each document's own values."""
    sents = settle(sentences(docs))
    return segment_refined(docs, sents, settle(text_series(docs, window)), share, floor, window, **sizes)


def segment_hybrid(docs: DataFrame, share: float = ADAPTIVE_SHARE, floor: float = ADAPTIVE_FLOOR, window: int = WINDOW, **sizes: int) -> DataFrame:
    """TF-IDF and compression divergence fused by rank, then as in segment_adaptive."""
    sents = settle(sentences(docs))
    wins = sentence_windows(sents, window)
    ncd = adjacent_compression_distance(wins).select("id", "win", F.col("value").alias("ncd"))
    both = text_series(docs, window).withColumnRenamed("value", "tfidf").join(ncd, ["id", "win"])
    fused = rank_fusion(both, ["tfidf", "ncd"], "id", "win").select("id", "win", F.col("fused").alias("value"), "end_pos")
    return segment_refined(docs, sents, settle(fused), share, floor, window, **sizes)


#: Strategies by name: docs (doc_id, text) to (id, seg_no, start, end).
STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "punctuation": segment_by_punctuation, "divergence": segment_by_divergence, "tfidf": segment_by_tfidf,
    "adaptive": segment_adaptive, "hybrid": segment_hybrid,
}


def segment(docs: DataFrame, strategy: str, **settings) -> DataFrame:
    """Segments by the named strategy."""
    return STRATEGIES[strategy](docs, **settings)


def segment_texts(segments: DataFrame, docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """(id, seg_no, label, text): the text of each segment and its padded number."""
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("full"))
    body = F.substring(F.col("full"), F.col("start") + 1, F.col("end") - F.col("start"))
    return segments.join(source, "id").select("id", "seg_no", F.lpad(F.col("seg_no").cast("string"), 4, "0").alias("label"), body.alias("text"))
