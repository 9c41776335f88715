"""Exact similarity self-joins above a threshold.

Two documents can only reach the threshold when they share a term inside their prefixes: the
rarest terms of a document up to the point where the rest alone cannot reach it. Only prefixes
are joined, each meeting is tested against an upper bound, and the survivors are scored on
their whole vectors. A term that fills many prefixes is split over several join keys.

Bounds, with a document's terms in ascending (df, term) order and unit vectors:
  cosine  rest norm below t                 => prefix may end
  jsd     g(rest mass, 1) below t           => prefix may end, with
          g(a, b) = (a*log2((a+b)/a) + b*log2((a+b)/b)) / 2, concave and homogeneous,
          so a sum of g over terms is at most g of the summed masses
At the first shared term of a pair nothing before it is shared, hence
  similarity <= contribution(term) + bound(rest left, rest right).

Common words meet in numbers that grow with the square of the corpus. ``similar_pairs`` and ``hybrid_scores``
therefore let packed blocks of documents meet (``vector_blocks``), where meetings never leave their task.
``candidate_pairs`` is the same search as a join of rows; there a meeting leaves the join
only if the sketches of both documents allow the threshold (``sketch_room``): bits of the prefix terms
bound what the prefixes share, the mass above each power of two of df bounds what lies behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexiloom.operators import lexical, vector_blocks as vb
from lexiloom.session import settle

SLACK = 1e-9
HOT_KEY_ROWS = 20000
# Sketch sizes: words of 64 bits for prefix terms, words of eight levels of df (2**0 to 2**23).
MASK_WORDS, LEVEL_WORDS = 16, 3
TOP_LEVEL = 8 * LEVEL_WORDS - 1
SKETCH = ["spare", "top", "mass", "cut", *[f"m{k}" for k in range(MASK_WORDS)], *[f"p{k}" for k in range(LEVEL_WORDS)]]


def jsd_part(a: Column, b: Column) -> Column:
    """Contribution of a shared term with shares a and b to the Jensen-Shannon similarity."""
    return 0.5 * (a * F.log2((a + b) / a) + b * F.log2((a + b) / b))


def _rest_bound(kind: str, a: Column, b: Column) -> Column:
    if kind == "cosine":
        return a * b
    return F.when((a > SLACK) & (b > SLACK), jsd_part(a, b)).otherwise(F.lit(1e-6))


def _contribution(kind: str, a: Column, b: Column) -> Column:
    return a * b if kind == "cosine" else jsd_part(a, b)


def ranked_vectors(weights: DataFrame, kind: str) -> DataFrame:
    """(id, copies, term, df, w, here, rest): ``here``/``rest`` bound the vector from and after a term."""
    doc = W.partitionBy("id")
    tail = doc.orderBy(F.col("df").desc(), F.col("term").desc()).rowsBetween(W.unboundedPreceding, 0)
    if kind == "cosine":
        unit = weights.withColumn("sq", F.col("w") * F.col("w"))
        unit = unit.withColumn("total", F.sum("sq").over(doc)).withColumn("tail", F.sum("sq").over(tail))
        unit = unit.withColumn("here", F.sqrt(F.col("tail") / F.col("total")))
        unit = unit.withColumn("rest", F.sqrt(F.greatest(F.col("tail") - F.col("sq"), F.lit(0.0)) / F.col("total")))
        return unit.withColumn("w", F.col("w") / F.sqrt("total")).drop("sq", "total", "tail")
    unit = weights.withColumn("here", F.sum("w").over(tail))
    return unit.withColumn("rest", F.greatest(F.col("here") - F.col("w"), F.lit(0.0)))


def indexed_vectors(weights: DataFrame, kind: str, threshold: float) -> DataFrame:
    """One settled row per document: (id, vec, tail, prefix) and its sketch.

    ``vec`` holds (term, w) sorted by term, ``prefix`` the entries that can carry a pair over the
    threshold, ``tail`` what is left behind the prefix. All are bounded by the document's own
    vocabulary. The join reads the prefixes twice and the scoring reads the vectors twice, hence
    the table is written once.
    """
    here = F.col("here")
    inside = (here if kind == "cosine" else jsd_part(here, F.lit(1.0))) >= threshold - SLACK
    packed = ranked_vectors(weights, kind).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("term", "w"))).alias("vec"),
        F.collect_list(F.when(inside, F.struct("term", "df", "w", "here", "rest"))).alias("prefix"),
        F.coalesce(F.max(F.when(~inside, here)), F.lit(0.0)).alias("tail"),
        *_sketch(kind, inside),
    )
    return settle(packed.withColumn("spare", F.size("prefix") - sum((F.bit_count(f"m{k}") for k in range(MASK_WORDS)), F.lit(0))))


def _level(df: Column) -> Column:
    return F.least(F.floor(F.log2(df) + SLACK).cast("int"), F.lit(TOP_LEVEL))


def _sketch(kind: str, inside: Column) -> list[Column]:
    """Aggregates per document: bits of the prefix terms, the largest share and the sum of the prefix, the
    level of its last term, and per level, in bytes rounded up, what the terms of that df or more hold."""
    share = F.col("w") * F.col("w") if kind == "cosine" else F.col("w")
    bit = F.pmod(F.xxhash64("term"), F.lit(64 * MASK_WORDS)).cast("int")
    in_word = [F.when(inside & (F.floor(bit / 64) == k), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit % 64)) for k in range(MASK_WORDS)]
    masks = [F.coalesce(F.bit_or(word), F.lit(0).cast("bigint")).alias(f"m{k}") for k, word in enumerate(in_word)]

    def held(level: int) -> Column:
        above = F.coalesce(F.sum(F.when(_level(F.col("df")) >= level, share)), F.lit(0.0))
        size = F.sqrt(above) if kind == "cosine" else above
        return F.least(F.ceil(size * 255 + SLACK), F.lit(255)).cast("bigint")

    levels = []
    for word in range(LEVEL_WORDS):
        packed = F.lit(0).cast("bigint")
        for k in range(8):
            packed = packed.bitwiseOR(F.shiftleft(held(8 * word + k), 8 * k))
        levels.append(packed.alias(f"p{word}"))
    return [
        *masks,
        *levels,
        F.max(F.when(inside, share)).alias("top"),
        F.sum(F.when(inside, share)).alias("mass"),
        F.max(F.when(inside, _level(F.col("df")))).alias("cut"),
    ]


def sketch_room(kind: str) -> Column:
    """Upper bound of the similarity of rows ``a`` and ``b`` from their sketches alone.

    A shared term lies in both prefixes, or behind the prefix that ends first. Terms of both set the same
    bit on both sides; terms of one side that share a bit are counted in ``spare``. The sum over s shared
    terms is at most the bound on s times the largest share of each side, or on its whole prefix.
    """
    common = sum((F.bit_count(F.col(f"a.m{k}").bitwiseAND(F.col(f"b.m{k}"))) for k in range(MASK_WORDS)), F.lit(0))
    shared = common + F.least("a.spare", "b.spare")

    def inside(side: str) -> Column:
        most = F.least(shared * F.col(f"{side}.top"), F.col(f"{side}.mass"))
        return F.sqrt(most) if kind == "cosine" else most

    def behind(side: str, cut: Column) -> Column:
        word = F.lit(0).cast("bigint")
        for k in reversed(range(LEVEL_WORDS)):
            word = F.col(f"{side}.p{k}") if k == LEVEL_WORDS - 1 else F.when(cut < 8 * (k + 1), F.col(f"{side}.p{k}")).otherwise(word)
        return F.call_function("shiftrightunsigned", word, 8 * (cut % 8)).bitwiseAND(F.lit(255)) / 255.0

    def after(first: str, second: str) -> Column:
        ends = F.col(f"{first}.cut") <= F.col(f"{second}.cut")
        return F.when(ends, _rest_bound(kind, F.col(f"{first}.tail"), behind(second, F.col(f"{first}.cut")))).otherwise(0.0)

    return _rest_bound(kind, inside("a"), inside("b")) + F.greatest(after("a", "b"), after("b", "a"))


def prefix_postings(indexed: DataFrame) -> DataFrame:
    return indexed.select("id", "tail", *SKETCH, F.inline("prefix"))


def spread_self_join(
    rows: DataFrame,
    keys: list[str],
    size: str,
    condition,
    id_col: str = "id",
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Pairs (left.id < right.id) of rows that agree on ``keys`` and meet ``condition``.

    ``size`` bounds the rows per key. A key above ``hot_rows`` is split: its left rows go to
    one of size/hot_rows sub-keys, its right rows to all of them, so no task holds the group.
    """
    parts = F.ceil(F.col(size) / F.lit(hot_rows)).cast("int")
    left = rows.withColumn("part", F.pmod(F.xxhash64(id_col), parts).cast("int"))
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    a, b = left.alias("a"), right.alias("b")
    on = (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.col("a.part") == F.col("b.part"))
    for key in keys:
        on = on & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    return a.join(b, on & condition)


def candidate_pairs(indexed: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Distinct (id1, id2) that may reach the threshold: a superset of the result.

    Every meeting must leave room for the threshold given what lies before and after it. Per
    pair, the sketches and then the exact score over the met prefix terms plus a bound on the rest must
    reach it: any other shared term lies behind the last one met and behind one of the two prefixes.
    """
    def before(side: str) -> Column:
        here = F.col(f"{side}.here")
        lost = 1.0 - (here * here if kind == "cosine" else here)
        room = F.greatest(lost, F.lit(0.0))
        return F.sqrt(room) if kind == "cosine" else room

    part = _contribution(kind, F.col("a.w"), F.col("b.w"))
    room = _rest_bound(kind, before("a"), before("b")) + part + _rest_bound(kind, F.col("a.rest"), F.col("b.rest"))
    able = (room >= threshold - SLACK) & (sketch_room(kind) >= threshold - SLACK)
    postings = prefix_postings(indexed)
    # Both sides of the colder keys are one shuffle; only hot keys are dealt twice.
    cold, hot = postings.where(F.col("df") <= HOT_KEY_ROWS), postings.where(F.col("df") > HOT_KEY_ROWS)
    on = (F.col("a.term") == F.col("b.term")) & (F.col("a.id") < F.col("b.id"))
    ends = [F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), part.alias("part")]
    ends += [F.col(f"{side}.{c}").alias(f"{c}{n}") for n, side in ((1, "a"), (2, "b")) for c in ("rest", "tail")]
    met = cold.alias("a").join(cold.alias("b"), on & able).select(*ends)
    met = met.unionByName(spread_self_join(hot, ["term"], "df", able).select(*ends))
    per_pair = met.groupBy("id1", "id2").agg(
        F.sum("part").alias("score"), *[F.min(c).alias(c) for c in ("rest1", "rest2", "tail1", "tail2")]
    )
    open_rest = F.greatest(
        _rest_bound(kind, F.least("tail1", "rest1"), F.col("rest2")),
        _rest_bound(kind, F.col("rest1"), F.least("tail2", "rest2")),
    )
    return per_pair.where(F.col("score") + open_rest >= threshold - SLACK).select("id1", "id2")


def packed_vectors(weights: DataFrame) -> DataFrame:
    """(id, vec): one array of (term, w) sorted by term per document."""
    return weights.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("vec"))


def merged_sum(left: Column, right: Column, part) -> Column:
    """Sum of part(a, b) over the weights of the terms two packed vectors share.

    The concatenation is sorted once, so a shared term stands twice in a row: a single linear
    pass, no explode and no further shuffle.
    """
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w"), F.lit(0.0).alias("total"))

    def step(acc: Column, x: Column) -> Column:
        gain = F.when(acc["term"] == x["term"], part(acc["w"], x["w"])).otherwise(F.lit(0.0))
        return F.struct(x["term"].alias("term"), x["w"].alias("w"), (acc["total"] + gain).alias("total"))

    return F.aggregate(F.sort_array(F.concat(left, right)), start, step, lambda acc: acc["total"])


def score_pairs(candidates: DataFrame, vectors: DataFrame, kind: str, name: str = "sim") -> DataFrame:
    """Exact similarity of each candidate pair; other candidate columns are kept."""
    a = vectors.select(F.col("id").alias("id1"), F.col("vec").alias("vec1"))
    b = vectors.select(F.col("id").alias("id2"), F.col("vec").alias("vec2"))
    value = merged_sum(F.col("vec1"), F.col("vec2"), lambda x, y: _contribution(kind, x, y))
    return (
        candidates.join(a, "id1")
        .join(b, "id2")
        .withColumn(name, F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 6))
        .drop("vec1", "vec2")
    )


def _six_decimals(score: str) -> Column:
    return F.round(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)), 6)


def similar_pairs(weights: DataFrame, kind: str, threshold: float, entries: int | None = None) -> DataFrame:
    """(id1, id2, sim) over distinct texts with sim >= threshold; threshold must be positive.

    ``weights``: (id, term, df, w), and pos where terms are numbered already; ``entries``: its rows, if known.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less asks for every pair; use small_all_pairs")
    if "pos" not in weights.columns:
        weights = weights.join(vb.numbered_terms(weights.select("term", "df").distinct()).select("term", "pos"), "term")
    name, score = ("w", "cosine") if kind == "cosine" else ("share", "jsd")
    searches = [(name, threshold)]
    blocks = vb.vector_blocks(weights.select("id", "pos", F.col("w").alias(name)), searches, entries)
    scored = vb.similar_block_pairs(blocks, searches).select("id1", "id2", _six_decimals(score).alias("sim"))
    return scored.where(F.col("sim") >= threshold)


def no_pairs(rows: DataFrame) -> DataFrame:
    """The empty result of a threshold above 1."""
    return rows.select(F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("sim")).where(F.lit(False))


# Fixed value: the share of the threshold at which candidates for a user score are taken.
CANDIDATE_RELAXATION = 0.5
BRUTE_FORCE_MAX = 10


def small_all_pairs(rows: DataFrame, id_col: str = "id", limit: int = BRUTE_FORCE_MAX) -> DataFrame:
    """Every unordered pair of a handful of rows. Refuses more than ``limit`` rows."""
    held = rows.select(id_col).limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError(f"all pairs are formed for at most {limit} rows; use a positive threshold")
    ids = sorted(r[0] for r in held)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.sparkSession.createDataFrame(pairs, f"id1 {kind}, id2 {kind}")


def counted_terms(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, copies, dl, term, n) of the distinct texts, the numbered terms (term, df, pos), and how many rows the
    former has. Both are written once."""
    tf = settle(lexical.corpus_tf(docs, lengths=True, **columns))
    return tf, vb.numbered_terms(lexical.document_frequency(tf, "copies")), tf.count()


def corpus_weights(docs: DataFrame, strategy: str, **columns: str) -> tuple[DataFrame, str, int]:
    """Weighted vectors of a corpus, the kernel that compares them, and the number of their entries."""
    if strategy not in ("tfidf", "bm25", "jsd"):
        raise ValueError(f"unknown strategy {strategy!r}")
    tf, terms, entries = counted_terms(docs, **columns)
    if strategy == "tfidf":
        return lexical.tfidf_weights(tf, lexical.corpus_size(docs), terms), "cosine", entries
    if strategy == "bm25":
        return lexical.bm25_weights(tf, lexical.corpus_size(docs), lexical.average_length(tf), terms), "cosine", entries
    return lexical.probability_weights(tf, terms), "jsd", entries


def strategy_weights(docs: DataFrame, strategy: str, **columns: str) -> tuple[DataFrame, str]:
    """Weighted vectors of a corpus and the kernel that compares them."""
    return corpus_weights(docs, strategy, **columns)[:2]


# Evidence fusion of the two lexical scores.
CONCORDANCE_BAND = 0.15
CONCORDANCE_BONUS = 1.1
DISCORDANCE_HIGH = 0.7
DISCORDANCE_LOW = 0.3
DISCORDANCE_PENALTY = 0.85
# Fusion with the structural score.
CROSS_SIGNAL_BOOST = 1.08
CONTRADICTION_RATIO = 0.5
CONTRADICTION_DISCOUNT = 0.75
PARTIAL_HIGH = 0.65
PARTIAL_LOW = 0.35


def fuse_lexical(bm25: Column, jsd: Column) -> Column:
    """Agreeing scores are averaged with a bonus, disagreeing ones blended with a penalty."""
    high, low = F.greatest(bm25, jsd), F.least(bm25, jsd)
    agree = F.least((bm25 + jsd) / 2.0 * CONCORDANCE_BONUS, F.lit(1.0))
    differ = (high * DISCORDANCE_HIGH + low * DISCORDANCE_LOW) * DISCORDANCE_PENALTY
    return F.when(high - low <= CONCORDANCE_BAND, agree).otherwise(differ)


def fuse_structural(lexical_score: Column, structural: Column, threshold: float) -> Column:
    """Combines lexical and tree evidence; a null structural score leaves the lexical one."""
    high, low = F.greatest(lexical_score, structural), F.least(lexical_score, structural)
    both = (lexical_score >= threshold) & (structural >= threshold)
    return (
        F.when(structural.isNull(), lexical_score)
        .when(both, F.least(high * CROSS_SIGNAL_BOOST, F.lit(1.0)))
        .when(structural < lexical_score * CONTRADICTION_RATIO, lexical_score * CONTRADICTION_DISCOUNT)
        .otherwise(high * PARTIAL_HIGH + low * PARTIAL_LOW)
    )


# Below this bound a search by one signal would read most of its postings.
LEAST_SINGLE_BOUND = 0.3


def fused_bound(threshold: float) -> float:
    """The lowest score of either signal at which the fused one can still reach the threshold.

    The fusion grows with both signals. The other signal is at most 1, and at most CONCORDANCE_BAND
    away where the two agree.
    """
    mean = threshold / CONCORDANCE_BONUS
    agree = mean - CONCORDANCE_BAND / 2.0
    if agree + CONCORDANCE_BAND > 1.0:
        agree = 2.0 * mean - 1.0
    differ = (threshold / DISCORDANCE_PENALTY - DISCORDANCE_HIGH) / DISCORDANCE_LOW
    return max(min(agree, differ), 0.0)


def hybrid_scores(docs: DataFrame, threshold: float, **columns: str) -> DataFrame:
    """(id1, id2, bm25, jsd, sim): every pair whose fused BM25 and JSD score reaches the threshold.

    Candidates come from BM25 at the lowest score that the fusion leaves room for. Where that is too low
    to prune, they are the pairs that reach threshold / CONCORDANCE_BONUS in one signal or the other: with
    both below it, the fused score is below the threshold. Blocks hold both signals, so both are scored there.
    """
    tf, terms, entries = counted_terms(docs, **columns)
    shares = tf.withColumn("share", F.col("n") / F.col("dl"))
    both = lexical.bm25_weights(shares, lexical.corpus_size(docs), lexical.average_length(tf), terms)
    bound = fused_bound(threshold) - 1e-5
    either = threshold / CONCORDANCE_BONUS - 1e-5
    searches = [("w", bound)] if bound >= LEAST_SINGLE_BOUND else [("w", either), ("share", either)]
    found = vb.similar_block_pairs(vb.vector_blocks(both, searches, entries), searches)
    scored = found.select("id1", "id2", _six_decimals("cosine").alias("bm25"), _six_decimals("jsd").alias("jsd"))
    return scored.withColumn("sim", F.round(fuse_lexical(F.col("bm25"), F.col("jsd")), 6)).where(F.col("sim") >= threshold)


def compare(docs: DataFrame, strategy: str, threshold: float, **columns: str) -> DataFrame:
    """Similar pairs of distinct texts under a named strategy."""
    if threshold > 1.0:
        return no_pairs(docs.select(F.col(columns.get("doc_id", "doc_id")).alias("id")))
    if strategy == "hybrid":
        return hybrid_scores(docs, threshold, **columns).select("id1", "id2", "sim")
    weights, kind, entries = corpus_weights(docs, strategy, **columns)
    return similar_pairs(weights, kind, threshold, entries)


def with_copies(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Adds each copy as one row (representative, copy, 1.0): linear in the corpus, nothing lost."""
    star = members.where(F.col("id") != F.col("rep_id")).select(
        F.col("rep_id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("sim")
    )
    return pairs.select("id1", "id2", "sim").unionByName(star)


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The full listing over single documents. Its size is that of the answer itself, which is
    quadratic in the number of copies; keep the folded form unless the listing is wanted."""
    a = members.select(F.col("rep_id").alias("id1"), F.col("id").alias("m1"))
    b = members.select(F.col("rep_id").alias("id2"), F.col("id").alias("m2"))
    across = pairs.join(a, "id1").join(b, "id2").select("m1", "m2", "sim")
    within = (
        a.join(b, F.col("id1") == F.col("id2")).where(F.col("m1") < F.col("m2")).select("m1", "m2", F.lit(1.0).alias("sim"))
    )
    both = across.unionByName(within)
    return both.select(F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"), "sim")


def expand_across(pairs: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """The full listing over single rows, of pairs whose ``group`` differs; ``members``: (id, rep_id, group).

    Its size is that of the answer. Rows of one representative meet under a split key, however many they are.
    """
    held = settle(members.select("id", "rep_id", F.col(group).alias("grp")))
    a, b = held.toDF("m1", "id1", "g1"), held.toDF("m2", "id2", "g2")
    across = pairs.join(a, "id1").join(b, "id2").where("g1 <> g2").select("m1", "m2", "sim")
    sizes = held.groupBy("rep_id").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    within = spread_self_join(held.join(sizes, "rep_id"), ["rep_id"], "size", F.col("a.grp") != F.col("b.grp"))
    both = across.unionByName(within.select(F.col("a.id").alias("m1"), F.col("b.id").alias("m2"), F.lit(1.0).alias("sim")))
    return both.select(F.least("m1", "m2").alias("id1"), F.greatest("m1", "m2").alias("id2"), "sim")


def folded_counts(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(sim, pairs): how many document pairs stand behind each similarity value, copies included."""
    a = groups.select(F.col("rep_id").alias("id1"), F.col("copies").alias("c1"))
    b = groups.select(F.col("rep_id").alias("id2"), F.col("copies").alias("c2"))
    across = pairs.join(a, "id1").join(b, "id2").select("sim", (F.col("c1") * F.col("c2")).alias("k"))
    within = groups.where(F.col("copies") > 1).select(
        F.lit(1.0).alias("sim"), (F.col("copies") * (F.col("copies") - 1) / 2).cast("bigint").alias("k")
    )
    return across.unionByName(within).groupBy("sim").agg(F.sum("k").alias("pairs"))


# Fixed value: ln(1e6), which puts the p-value of a perfect match a millionth below the base rate.
TAIL_DECADES = 13.815510558


def false_discovery_cut(counts: DataFrame, alpha: float, total_pairs: Column, threshold: float) -> DataFrame:
    """One row (cut): the lowest similarity kept by the Benjamini-Hochberg step-up rule.

    Works on (sim, pairs) counts. Similarities carry six decimals, so there are at most a
    million of them and the ranking window is bounded whatever the number of pairs.
    """
    rate = TAIL_DECADES / (1.0 - threshold) if 1.0 - threshold > 1e-10 else 1.0
    # Every path to the window goes through the aggregate per distinct similarity.
    ranked = counts.withColumn("rank", F.sum("pairs").over(W.orderBy(F.col("sim").desc()))).withColumn(
        "matches", F.sum("pairs").over(W.partitionBy())
    )
    p = F.col("matches") / total_pairs * F.exp(-rate * (F.col("sim") - threshold))
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0))
    kept = ranked.where(p <= F.col("rank") / total_pairs * alpha)
    return kept.agg(F.min("sim").alias("cut"))


def false_discovery_filter(
    pairs: DataFrame, counts: DataFrame, alpha: float, total_pairs: Column, threshold: float
) -> DataFrame:
    """Pairs that survive the correction; alpha <= 0 keeps none and alpha >= 1 keeps all."""
    if alpha <= 0:
        return pairs.where(F.lit(False))
    if alpha >= 1:
        return pairs
    cut = false_discovery_cut(counts, alpha, total_pairs, threshold)
    return pairs.where(F.col("sim") >= cut.scalar())


def cross_group(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose names have different, non-empty prefixes before the colon."""
    a, b = F.split_part(F.col(left), F.lit(":"), F.lit(1)), F.split_part(F.col(right), F.lit(":"), F.lit(1))
    return pairs.where((a != b) & (a != "") & (b != ""))


def cross_group_pair_count(docs: DataFrame, group: str) -> DataFrame:
    """Number of pairs across groups, at least 1, from group sizes alone."""
    sizes = docs.groupBy(group).agg(F.count(F.lit(1)).alias("c"))
    total, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
    return sizes.agg(F.greatest(((total * total - squares) / 2).cast("bigint"), F.lit(1).cast("bigint")).alias("pairs"))
