"""Operator 1: chat formatting with typed content parts, in DataFrame functions only.

A message is a role and an array of parts, each with a type and the fields of that type. A
visitor goes over the parts in order: text is escaped, image, audio and document parts become
placeholders, and each attachment is recorded with its place, its reference and the number of
tokens its placeholder expands to.

The template opens and closes each turn with control strings. All control strings begin with
``<`` or ``[``. Escaping puts a backslash after each ``<`` and ``[`` of a text, so no control
string can begin inside a text; unescaping takes that one backslash away again, which gives any
text back exactly, backslashes of its own included.

Defined results: null text, role or parts count as empty; an unknown part type counts as text;
turns that tie are ordered by role and text; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows. A conversation is one output
row, so its turns meet in one task by contract; nothing larger than a conversation does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Fixed values of the template.
START, SEP, END = "<|turn|>", "<|says|>", "<|done|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens: a tile of an image, a second of audio, a page of a document.
IMAGE_TILE, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def visit_text(part: Column) -> Column:
    """What a part leaves in the formatted text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def visit_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text."""
    least = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    tiles = lambda c: F.ceil(least(c) / IMAGE_TILE)
    return (
        F.when(part["type"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_PER_SECOND))
        .when(part["type"] == "document", least(part["pages"]) * DOCUMENT_PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def text_parts(text: Column) -> Column:
    """A plain text as the one part of a message."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def format_chat(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Conversations from rows of ``conv_id``, ``turn``, ``role``, ``parts``.

    Returns conv_id, formatted, loss_spans (start and length in code points, and in bytes),
    attachments (turn's place, part's place, type, ref, tokens), n_attachments, expanded_tokens.
    The window and the aggregate share one exchange by conv_id.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    head = lambda role: F.concat(F.lit(START), escape(role), F.lit(SEP))
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, visit_text), "").alias("body"),
        F.filter(
            F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), visit_tokens(p).alias("tokens"))),
            lambda a: a["type"].isin(*PLACEHOLDERS),
        ).alias("found"),
    )
    rows = rows.withColumn("piece", F.concat(head(F.col("role")), F.col("body"), F.lit(END), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = lambda size, own: F.coalesce(F.sum(size(F.col("piece"))).over(before), F.lit(0)) + size(own)
    rows = rows.select(
        "conv_id", "role", "body", "piece", "found", F.row_number().over(order).alias("n"),
        start(F.char_length, head(F.col("role"))).alias("start"), start(F.octet_length, head(F.col("role"))).alias("byte"),
    )
    span = F.struct(F.col("start"), F.char_length("body").cast("long").alias("length"), F.col("byte"), F.octet_length("body").cast("long").alias("bytes"))
    got = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.col("role") == learn_role, span))).alias("loss_spans"),
        F.array_sort(F.collect_list(F.when(F.size("found") > 0, F.struct("n", "found")))).alias("found"),
    )
    attachments = F.flatten(F.transform("found", lambda x: F.transform(x["found"], lambda a: F.struct(x["n"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return got.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans", attachments.alias("attachments")).withColumns(
        {"n_attachments": F.size("attachments").cast("long"), "expanded_tokens": F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])}
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, from the formatted text alone."""
    pieces = F.filter(F.split("formatted", r"<\|done\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, SEP, -1)
        role = F.substring_index(F.substring_index(piece, SEP, 1), START, -1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    data = formatted.withColumn("data", F.encode("formatted", "UTF-8"))
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(F.col("data"), (s["byte"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))), "")
    return data.withColumns({"turns": F.transform(pieces, turn), "learnt": learnt}).drop("data")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all conversations, and one (-1) whose texts hold control strings of other templates."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = rows.unionByName(odd).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    back = read_back(format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "n_attachments", "expanded_tokens",
    )


OP1_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, replace(replace(role, '<', '<\\'), '[', '[\\') AS r, replace(replace(text, '<', '<\\'), '[', '[\\') AS t FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 25) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM sized GROUP BY conv_id
"""
