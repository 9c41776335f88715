"""Headings, sections, fragments and page proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lexiloom.functions import hashing, text as tx


def markdown_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line, level): level is the heading depth or null."""
    lines = docs.select(F.col(doc_id).alias("id"), F.posexplode(tx.text_lines(F.col(text))).alias("p", "line"))
    marks = F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1)
    level = F.when(marks != "", F.char_length(marks))
    title = F.regexp_replace("line", r"^#{1,6}[ \t]+", "")
    return lines.select(
        "id", (F.col("p") + 1).alias("line_no"), F.when(level.isNotNull(), title).otherwise(F.col("line")).alias("line"), level.alias("level")
    )


def _numbered(lines: DataFrame) -> DataFrame:
    running = W.partitionBy("id").orderBy("line_no")
    return lines.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(running))


def sections(lines: DataFrame) -> DataFrame:
    """(id, section, title, level, start_line, end_line, content); text before the first heading
    and sections without content are dropped. ``lines``: (id, line_no, line, level)."""
    body = F.when(F.col("level").isNull(), F.struct("line_no", "line"))
    grouped = (
        _numbered(lines)
        .where("section > 0")
        .groupBy("id", "section")
        .agg(
            F.max(F.when(F.col("level").isNotNull(), F.col("line"))).alias("title"),
            F.max("level").alias("level"),
            F.min("line_no").alias("start_line"),
            F.max("line_no").alias("end_line"),
            # As large as one section of one document.
            F.sort_array(F.collect_list(body)).alias("body"),
        )
    )
    content = F.array_join(F.transform("body", lambda b: b["line"]), "\n")
    full = grouped.withColumn("content", tx.trim_blanks(content)).drop("body")
    return full.where("content <> ''")


def section_ids(secs: DataFrame) -> DataFrame:
    anchor = tx.title_to_slug(F.col("title"))
    return secs.withColumn("section_id", F.concat(F.col("id").cast("string"), F.lit("#"), anchor, F.lit("-"), F.col("section").cast("string")))


def fragments(lines: DataFrame) -> DataFrame:
    """(id, line_no, heading, content, fragment_id): every non-empty line under its heading."""
    order = W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("level").isNotNull(), F.col("line")), ignorenulls=True).over(order)
    rows = lines.select("id", "line_no", heading.alias("heading"), F.col("line").alias("content"), "level")
    digest = hashing.short_hash(F.concat_ws("|", F.col("id").cast("string"), F.col("line_no").cast("string"), "content"))
    return rows.where("level IS NULL AND content <> ''").drop("level").withColumn("fragment_id", digest)


def numbered_acts(secs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, act_no, title, content): the sections of a document in order; without any, its whole text is one act."""
    rank = F.row_number().over(W.partitionBy("id").orderBy("section"))
    numbered = secs.select("id", rank.alias("act_no"), "title", "content")
    rest = lines.join(secs.select("id").distinct(), "id", "left_anti")
    # As large as one document.
    whole = rest.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("body"))
    content = F.array_join(F.transform("body", lambda b: b["line"]), "\n")
    return numbered.unionByName(whole.select("id", F.lit(1).alias("act_no"), F.col("id").cast("string").alias("title"), content.alias("content")))


def facts_in_sections(facts: DataFrame, secs: DataFrame) -> DataFrame:
    """Facts (id, line, ...) with the section whose lines hold them."""
    spans = secs.select("id", "section", "start_line", "end_line")
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    return facts.join(spans, "id").where(inside).drop("start_line", "end_line")


def page_proposals(secs: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, title, source, chars): a page per section, or per document without sections.

    ``docs``: (id, chars), the length of each whole document.
    """
    from_sections = secs.select(
        F.concat_ws("/", F.col("id").cast("string"), tx.title_to_slug(F.col("title"))).alias("page_id"),
        F.col("title"),
        F.col("id").alias("source"),
        F.char_length("content").alias("chars"),
    )
    whole = docs.join(secs.select("id").distinct(), "id", "left_anti").select(
        F.col("id").cast("string").alias("page_id"), F.col("id").cast("string").alias("title"), F.col("id").alias("source"), "chars"
    )
    return from_sections.unionByName(whole)
