"""Checks on a set of linked pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexiloom.session import settle


def orphans(pages: DataFrame, *linked: DataFrame) -> DataFrame:
    """Pages (id) that none of the link sources (id) names."""
    left = pages.select("id")
    for source in linked:
        left = left.join(source.select("id"), "id", "left_anti")
    return left


def broken_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links (page, target) to targets that do not exist."""
    return links.join(known.select("target"), "target", "left_anti").select("page", "target")


def empty_pages(pages: DataFrame, minimum: int = 50) -> DataFrame:
    """Pages (id, text) with fewer than ``minimum`` characters other than blanks."""
    return pages.where(F.char_length(F.regexp_replace("text", r"\s", "")) < minimum).select("id")


def page_classes(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep_id): pages with equal sources and equal links, named by the smallest; a linked page is alone.

    What holds between two pages, their shared sources and links, holds for all pages of their classes.
    """
    held = sources.groupBy(F.col("page").alias("id")).agg(F.sort_array(F.collect_set("source")).alias("held"))
    linked = links.groupBy(F.col("page").alias("id")).agg(F.sort_array(F.collect_set("target")).alias("linked"))
    named = links.select(F.col("target").alias("id")).distinct().withColumn("own", F.col("id"))
    rows = held.join(linked, "id", "left").join(named, "id", "left")
    rows = rows.select("id", F.sha2(F.to_json(F.struct("held", "linked", "own")), 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("id").alias("rep_id")), "key").select("id", "rep_id")


# Pages of one class that travel as one array, and the most tasks that pair them.
CLASS_CHUNK, MOST_TASKS = 1000, 2000


def expand_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id1, id2, shared) of pages from (id1, id2, shared) of classes; a class paired with itself gives its inner pairs.

    Arrays of pages meet, so only these are shuffled; the pairs are formed where they leave.
    """
    sizes = members.groupBy("rep_id").agg(F.ceil(F.count(F.lit(1)) / CLASS_CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "rep_id").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    packed = settle(dealt.groupBy("rep_id", "chunk").agg(F.collect_list("id").alias("ids")))
    a, b = packed.toDF("id1", "c1", "m1"), packed.toDF("id2", "c2", "m2")
    same = F.col("id1") == F.col("id2")
    cells = lambda x, y: pairs.join(x, "id1").join(y, "id2").where(~same | (F.col("c1") <= F.col("c2")))
    tasks = min(max(1, cells(a.drop("m1"), b.drop("m2")).count()), MOST_TASKS)
    # Few rows hold many pairs: without a number, adaptive execution would put them into few tasks.
    spread = cells(a, b).repartition(tasks)
    inner = same & (F.col("c1") == F.col("c2"))
    each = spread.select("shared", inner.alias("inner"), F.explode("m1").alias("x"), "m2").select("shared", "inner", "x", F.explode("m2").alias("y"))
    return each.where(~F.col("inner") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "shared")


def missing_cross_references(sources: DataFrame, links: DataFrame, hot_rows: int) -> DataFrame:
    """(id1, id2, shared): pages that share a source while neither links the other.

    ``sources``: (page, source); ``links``: (page, target) between pages. Classes of equal pages are compared
    and expanded last. A source used by many classes is split over several join keys.
    """
    from lexiloom.operators.pairs import spread_self_join

    members = settle(page_classes(sources, links))
    chosen = members.select("rep_id").distinct()
    uses = sources.select(F.col("page").alias("id"), "source").distinct().join(chosen.toDF("id"), "id", "left_semi")
    sizes = uses.groupBy("source").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = spread_self_join(uses.join(sizes, "source"), ["source"], "size", F.lit(True), hot_rows=hot_rows)
    pairs = met.groupBy(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).agg(F.count(F.lit(1)).alias("shared"))
    # A link goes from a class to a page that is its own class.
    known = links.join(chosen.toDF("page"), "page", "left_semi").select(F.least("page", "target").alias("id1"), F.greatest("page", "target").alias("id2"))
    across = pairs.join(known.distinct(), ["id1", "id2"], "left_anti")
    several = members.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rep_id").alias("id"))
    within = uses.join(several, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    return expand_classes(settle(across.unionByName(within.select(F.col("id").alias("id1"), F.col("id").alias("id2"), "shared"))), members)


def report(**checks: tuple[DataFrame, str]) -> DataFrame:
    """(check, severity, page) of all checks; each value is (DataFrame with id, severity)."""
    parts = [
        df.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("page"))
        for name, (df, severity) in checks.items()
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every
