"""Chat formatting: typed content parts become one training text with a loss mask.

A message holds parts of type text, image, audio or document. Text is escaped into the output; any
other part becomes a numbered placeholder, its reference is recorded as an attachment, and the
placeholder stands for the part's expanded number of tokens. Only DataFrame functions are used.

    <turn>role<say>content</turn>

In contents and roles ``\\`` is written ``\\b`` and ``<`` is written ``\\l``, so no control string can stand inside
a text, and the two replacements undo each other in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, SAY, CLOSE = "<turn>", "<say>", "</turn>\n"
#: Tokens that a placeholder stands for, by type, if the part does not say.
TOKENS = {"image": 576, "audio": 750, "document": 1024}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of one text part; a null text is empty."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("tokens"))
    return F.array(part).cast(f"array<{PART}>")


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """(content, attachments) of a message: parts in order, placeholders numbered within the message.

    A null part, or a text part without text, adds nothing; a part of unknown type is kept as a document.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    parts = F.filter(parts, lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    kind = lambda p: F.when(p["type"].isin("image", "audio"), p["type"]).otherwise("document")
    others = F.filter(parts, lambda p: ~is_text(p))
    number = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: ~is_text(p)))
    content = F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<"), kind(p), F.lit(":"), number(i).cast("string"), F.lit(">"))
            ),
        ),
        "",
    )
    default = lambda p: F.when(kind(p) == "image", TOKENS["image"]).when(kind(p) == "audio", TOKENS["audio"]).otherwise(TOKENS["document"])
    attachments = F.transform(
        others,
        lambda p, i: F.struct(
            (i + 1).alias("number"), kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default(p).cast("bigint")).alias("tokens")
        ),
    )
    return content, attachments


def format_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, n_tokens_attached) from (conv_id, turn, role, parts).

    Turns stand in order of turn, then role and content; null turns come first. loss_spans holds the
    start and length in code points of each assistant content. Rows of a null conv_id form one
    conversation; a null role is empty; repeated rows are turns of their own; other columns are
    ignored. A conversation is one output text, so it is gathered as a whole; its offsets come from a
    window over the same keys.
    """
    content, attached = flatten_parts(F.col("parts"))
    m = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attached.alias("attached"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAY))
    m = m.withColumn("head", head).withColumn("line", F.concat("head", "content", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    numbered = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    m = m.withColumn("begin", F.coalesce(F.sum(F.length("line")).over(order), F.lit(0))).withColumn("n", F.row_number().over(numbered))
    span = F.struct((F.col("begin") + F.length("head")).alias("start"), F.length("content").cast("bigint").alias("length"))
    row = F.struct("n", "line", F.when(F.col("role") == "assistant", span).alias("span"), "attached")
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["n"].alias("message"), a.alias("part")))))
    g = g.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["part"]["tokens"])
    return g.withColumn("n_tokens_attached", tokens)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as (role, content) with escapes undone."""
    lines = F.split(formatted, F.lit(OPEN), -1)
    lines = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))

    def turn(line: Column) -> Column:
        role = F.substring_index(line, SAY, 1)
        said = F.substring(line, F.length(role) + len(SAY) + 1, F.length(line))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(said, CLOSE.strip(), 1)).alias("content"))

    return F.transform(lines, turn)


def read_masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, escapes undone, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
