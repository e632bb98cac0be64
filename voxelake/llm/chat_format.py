"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A conversation becomes one string::

    <s><turn ROLE>TEXT</turn><turn ROLE>TEXT</turn>...</s>

Inside roles and texts the characters that begin or end control strings are escaped, ``~`` first:
``~`` to ``~0``, ``<`` to ``~1``, ``>`` to ``~2``, ``[`` to ``~3``, ``]`` to ``~4``. No control string
of this template, nor ``</s>`` or ``[INST]``, can occur in an escaped text, and undoing the
replacements in reverse order gives the text back.

Every assistant turn becomes an example of its own: all that precedes it is context, and only that
reply is trainable. A conversation holds its examples as character spans of its string, so n turns take
space for n turns and not for n * n / 2; ``expand`` explodes them into one row each, with the context
and the reply spelt out. Whatever is trained on is read from those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: In this order; undone in reverse.
ESCAPES = (("~", "~0"), ("<", "~1"), (">", "~2"), ("[", "~3"), ("]", "~4"))
START, END, OPEN, HEAD, CLOSE = "<s>", "</s>", "<turn ", ">", "</turn>"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """Conversations of ``turns`` (conv_id, turn, role, text) as formatted strings with examples.

    Returns conv_id, formatted, examples array<struct<turn_no, context_end, target_start, target_end>>:
    the example for a reply has the characters [0, context_end) of ``formatted`` as context, and
    exactly those in [target_start, target_end) are trainable (0-based, end exclusive).

    Turns are put in order by turn (null first), then role, then text. Null roles and texts count as
    empty; rows that repeat are turns of their own. Null conv_ids form one conversation. A conversation
    is one string, however long it is. Empty input gives no rows; other columns are not read.
    """
    cleaned = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = cleaned.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("no"),
        (F.col("role") == "assistant").alias("reply"),
        F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(HEAD)).alias("head"),
        escaped(F.col("text")).alias("body"),
    ).withColumn("size", (F.char_length("head") + F.char_length("body") + len(CLOSE)).cast("long"))
    pieces = pieces.withColumn("end", F.sum("size").over(Window.partitionBy("conv_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)) + len(START))
    parts = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("no", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "reply", "end", F.char_length("body").alias("body_chars")))).alias("parts")
    )
    return parts.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.col("parts.piece"), ""), F.lit(END)).alias("formatted"),
        F.transform(
            F.filter("parts", lambda p: p["reply"]),
            lambda p: F.struct(
                (p["no"] - 1).alias("turn_no"),
                (p["end"] - len(CLOSE) - p["body_chars"]).alias("context_end"),
                (p["end"] - len(CLOSE) - p["body_chars"]).alias("target_start"),
                (p["end"] - len(CLOSE)).alias("target_end"),
            ),
        ).alias("examples"),
    )


def expand(formatted: DataFrame, outer: bool = False) -> DataFrame:
    """One row for each reply: conv_id, formatted, turn_no, context, target (both still escaped).

    All of ``context`` precedes the reply and is masked, all of ``target`` is trainable. A conversation
    without replies has no row, or with ``outer`` one whose turn_no, context and target are null. Empty
    replies are rows with an empty target; null conv_ids stay; an empty table gives no rows.
    """
    inline = F.inline_outer if outer else F.inline
    rows = formatted.select("conv_id", "formatted", inline("examples"))
    return rows.select(
        "conv_id",
        "formatted",
        "turn_no",
        F.substr("formatted", F.lit(1), F.col("context_end").cast("int")).alias("context"),
        F.substr("formatted", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")).alias("target"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` (conv_id, formatted, ...) with the turns that its strings hold: array<struct<role, text>>.

    Roles and texts come back as they were put in, null as empty, whatever control strings they hold.
    """
    inner = F.substr("formatted", F.lit(len(START) + 1), F.char_length("formatted") - len(START) - len(END))
    pieces = F.filter(F.split(inner, CLOSE, -1), lambda x: x != "")

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, HEAD, 1)
        return F.struct(
            unescaped(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"),
            unescaped(F.substr(piece, F.char_length(role) + len(HEAD) + 1)).alias("text"),
        )

    return formatted.withColumn("turns", F.transform(pieces, parse))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what formatted conversations hold: turns from their strings, the loss from the exploded examples.

    A conversation without replies has an empty loss; an empty table gives no rows.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # a conversation's examples lie together as its turns did, so nothing is shuffled again
    reply = F.when(F.col("turn_no").isNotNull(), F.struct("turn_no", "target"))
    gathered = expand(formatted, outer=True).groupBy("conv_id").agg(F.first("formatted").alias("formatted"), F.array_sort(F.collect_list(reply)).alias("replies"))
    loss = F.array_join(F.transform("replies", lambda e: unescaped(e["target"])), "")
    return read_back(gathered).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, -7, whose texts are made of control strings."""
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(turns.unionByName(extra)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^~<>\[\]]', '', 'g'))
          + length(role) + length(regexp_replace(role, '[^~<>\[\]]', '', 'g')) + 14 AS chars
  FROM t
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
