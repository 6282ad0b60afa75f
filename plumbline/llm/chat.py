r"""Operator 2: chat formatting with Spark expressions only.

Template: each block of turns by one role is ``<turn:ROLE>TEXT</turn>`` and a newline; the
texts of adjacent turns by the same role share a block, with ``<next>`` between them.  In
roles and texts ``\`` becomes ``\\``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so a
``<`` in the output is always the template's, and reading back gives the turns as they were.

A turn's place comes from one window over the conversation, and the turns' structs are
collected, sorted by it and joined in the same partitioning.  A conversation is one row of
the result, so its turns meet in one task; conversations spread over all tasks.

Edge cases: null texts and null roles are empty; turns are ordered by turn (null first), then
role and text, so ties and repeated rows have one order and all stay; an empty table gives an
empty result; other columns are ignored.  A null conv_id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Inverse of :func:`escape`; NUL pairs stand for the backslash meanwhile."""
    c = F.replace(F.replace(c, F.lit("\x00"), F.lit("\x00z")), F.lit("\\\\"), F.lit("\x00b"))
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(F.replace(c, F.lit("\x00b"), F.lit("\\")), F.lit("\x00z"), F.lit("\x00"))


def format_conversations(rows: DataFrame, trained_role: str = ASSISTANT) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to ``conv_id, formatted, loss_spans``.

    ``loss_spans`` are the places of the trained role's texts in ``formatted``, as structs of
    ``start`` (from 0) and ``length`` in code points.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    before = F.lag("role").over(order)
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))
    turns = turns.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.when(before.isNull(), head)
        .when(before == F.col("role"), F.lit("<next>"))
        .otherwise(F.concat(F.lit("</turn>\n"), head))
        .alias("mark"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("trained"),
    )
    upto = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.char_length("mark") + F.char_length("body")).over(upto)
    turns = turns.withColumn("start", end - F.char_length("body"))
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "mark", "body", "trained", "start"))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["mark"], t["body"])), "")
    spans = F.transform(
        F.filter("turns", lambda t: t["trained"]),
        lambda t: F.struct(t["start"].alias("start"), F.char_length(t["body"]).cast("long").alias("length")),
    )
    return packed.select("conv_id", F.concat(joined, F.lit("</turn>\n")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: an array of structs of role and text."""

    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.struct(unescape(F.regexp_extract(b, "^<turn:([^>]*)>", 1)).alias("role"), F.split(F.substr(b, F.locate(">", b) + 1), "<next>").alias("texts")))
    return F.flatten(F.transform(parts, lambda p: F.transform(p["texts"], lambda t: F.struct(p["role"].alias("role"), unescape(t).alias("text")))))


def masked_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from the output."""
    f = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
       + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '>', '')) AS body,
    length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', ''))
       + length(role) - length(replace(role, '>', '')) AS name
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(body + CASE WHEN before = role THEN 6 ELSE name + 7 + 8 END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
