"""Mixing sources to target weights by weighted fair queueing.

Every source queues its shuffled documents, up to ``MAX_REPEATS`` times over. A queued document has a
virtual finish time: the words of its source up to and including it, divided by the source's target.
All queues are then sorted by finish time in global order and truncated at the total budget. As
virtual time 1 is where every source has given its target, the document that a source is giving at
that time is cut there.

Running sums are taken in two steps, totals of ranges and sums within a range, so neither a hot
source nor the global order lands in one task: the shuffle key and the virtual time are themselves
cut into ranges that hold even shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
RANGE_BITS = 12
SEED = 17
SMALL_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and x09-x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, sid, weight, source_size, target) of each source from (source, size).

    Weights repeat over the sources in code-point order, null last. All sizes are shared by weight;
    a target stops at ``repeats`` times its source, and the rest is shared anew. With sources in order
    of limit per weight the stopped ones come first, so the final level is a running sum. The windows
    run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    s = s.withColumn("sid", rank).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    s = s.withColumn("limit", F.lit(float(repeats)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    by_limit = every.orderBy(F.col("limit") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))),
    )
    s = s.withColumn("free", F.col("limit") > F.col("weight") * F.col("level"))
    first_free = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "sid", "level"))).over(every)["level"]
    target = F.when(F.col("free"), F.least(F.col("weight") * first_free, F.col("limit"))).otherwise(F.col("limit"))
    return s.select("source", "sid", "weight", "source_size", target.alias("target"))


def _before(df: DataFrame, total: str, groups: list[str], rng: str) -> DataFrame:
    """(groups, range, ahead): the sum of ``total`` in the earlier ranges of each group."""
    sums = df.groupBy(*groups, rng).agg(F.sum(total).alias("t"))
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*groups, rng, F.coalesce(F.sum("t").over(w), F.lit(0)).alias("ahead"))


def queued(docs: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, sid, source_size, target, start) per row of ``docs``: start is the number
    of words ahead of a document in one round of its source's shuffled queue."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sources = source_targets(sized, weights, repeats)
    few = sources.count() <= SMALL_SOURCES
    sources = sources.withColumnRenamed("source", "its_source")
    joined = sized.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    q = joined.withColumn("key", key).withColumn("rng", F.shiftrightunsigned("key", 64 - RANGE_BITS))
    inside = Window.partitionBy("sid", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = _before(q, "size", ["sid"], "rng")
    q = q.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return q.join(ahead, ["sid", "rng"]).select(
        "doc_id", "source", "size", "sid", "source_size", "target", (F.col("ahead") + F.col("within")).alias("start")
    )


def mixed(queue: DataFrame, repeats: int = MAX_REPEATS, budget: int | None = None) -> DataFrame:
    """The mix: queue columns with round, finish, place (words ahead in the mix) and words taken.

    Sorted by finish time through even ranges of virtual time; words beyond the budget, the sum of
    all targets unless one is given, are cut.
    """
    has = F.col("size") > 0
    rounds = F.sequence(F.lit(0), F.lit(repeats - 1))
    items = queue.where(has).select("*", F.explode(rounds).alias("round"))
    begin = F.col("round") * F.col("source_size") + F.col("start")
    items = items.withColumn("begin", begin).where("round = 0 OR begin < target")
    whole = F.floor("target").cast("bigint")
    items = items.withColumn("words", F.greatest(F.lit(0), F.least("size", whole - F.col("begin"))).cast("bigint"))
    items = items.withColumn("finish", (F.col("begin") + F.col("size")) / F.col("target"))
    items = items.withColumn("rng", F.least(F.floor(F.col("finish") * (1 << RANGE_BITS)), F.lit(1 << RANGE_BITS)))
    # Documents that are cut all finish past 1, in the last range: at most one per source has words.
    past = F.when(F.col("words") == 0, F.pmod(F.xxhash64("sid", "begin"), F.lit(1 << RANGE_BITS))).otherwise(0)
    items = items.withColumn("tail", past)
    order = Window.partitionBy("rng", "tail").orderBy("finish", "sid", "begin").rowsBetween(Window.unboundedPreceding, -1)
    ahead = _before(items, "words", [], "rng")
    placed = items.withColumn("within", F.coalesce(F.sum("words").over(order), F.lit(0))).join(ahead, "rng")
    placed = placed.withColumn("place", F.col("ahead") + F.col("within"))
    if budget is not None:
        placed = placed.withColumn("words", F.greatest(F.lit(0), F.least("words", F.lit(budget) - F.col("place"))))
    return placed.drop("rng", "tail", "within", "ahead", "begin")


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs`` (doc_id, source, text).

    Texts without words take no part but are listed, with a target like their source's. Rows that
    repeat a doc_id are documents of their own, in fixed order. An empty table gives an empty result.
    """
    queue = queued(docs)
    keys = ["doc_id", "source", "size", "sid", "source_size", "target", "start"]
    got = mixed(queue).groupBy(*keys).agg(F.sum("words").alias("taken"))
    none = queue.where("size = 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return got.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them.

    Documents stay whole here: one that the truncation cuts stays if at least half of it is taken. Rows
    that repeat doc_id and source are taken equally often, as often as the mix takes one of them on
    average, rounded; so the mix keeps to its targets with them.
    """
    items = mixed(queued(docs))
    counts = items.groupBy("doc_id", "source").agg(F.count_if(F.expr("2 * words >= size")).alias("taken"), F.count_if(F.col("round") == 0).alias("rows"))
    times = counts.select(
        F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source"), F.round(F.col("taken") / F.col("rows")).cast("int").alias("times")
    ).where("times > 0")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source")
    met = rows.join(times, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & F.col("source").eqNullSafe(F.col("mixed_source")))
    return met.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
