"""Chat formatting by prefix-target expansion, in Spark SQL functions only.

Every assistant turn becomes one example: all turns before it as context, and only that reply trainable. Turns after
the last reply form one more row without a trainable part, so that nothing of a conversation is lost.

A turn reads ``<s>[ROLE]role[/ROLE]text</s>``. Strings that look like control strings get a backslash after their
first character, and one more if they had some already, so that reading back removes exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: What follows the first character of a control string.
TAIL = r"(/?s>|/?(?:ROLE|INST|SYS)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, "$1$2$3")


def frame(turn: Column) -> Column:
    return F.concat(F.lit("<s>[ROLE]"), escape(turn["role"]), F.lit("[/ROLE]"), escape(turn["text"]), F.lit("</s>"))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), formatted, loss_start, loss_length (code points; null in the last
    row of a conversation if turns follow its last reply).

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn, then role, then text,
    nulls first; null roles and texts are empty. Repeated rows are turns of their own. Rows with a null conv_id form one
    conversation. An empty table gives an empty result.
    """
    clean = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("all"))
    n = F.size("all")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("all", i)["role"] == "assistant")
    with_tail = whole.withColumn("ends", F.when(F.element_at("all", -1)["role"] == "assistant", replies).otherwise(F.concat(replies, F.array(-n))))
    each = with_tail.withColumn("frames", F.transform("all", frame)).select("conv_id", "all", "frames", F.posexplode("ends").alias("example", "end"))
    context = F.array_join(F.slice("frames", 1, F.abs("end") - 1), "")
    last = F.element_at("all", F.abs("end"))
    head = F.char_length(F.concat(F.lit("<s>[ROLE]"), escape(last["role"]), F.lit("[/ROLE]")))
    trained = F.col("end") > 0
    return each.select(
        "conv_id", "example", F.concat(context, F.element_at("frames", F.abs("end"))).alias("formatted"),
        F.when(trained, F.char_length(context) + head).alias("loss_start"), F.when(trained, F.char_length(escape(last["text"]))).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted examples alone."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(formatted, loss_start + 1, loss_length)"))).otherwise("")
    rows = examples.select("conv_id", "example", "formatted", loss.alias("loss"))
    by = rows.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("longest"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.char_length("formatted")).alias("formatted_chars"))
    frames = F.filter(F.split("longest", "</s>", -1), lambda x: x != "")
    body = F.transform(frames, lambda x: F.concat(unescape(F.regexp_extract(x, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)), F.lit("\n"), unescape(F.regexp_replace(x, r"(?s)^<s>\[ROLE\].*?\[/ROLE\]", "")), F.lit("\n")))
    text = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return by.select("conv_id", F.size(frames).cast("long").alias("n_turns"), F.sha2(F.array_join(body, ""), 256).alias("turns_sha256"), F.char_length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """All ``conversations``, and conversation -1 whose texts are full of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_chats(rows.unionByName(extra)))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<s>[ROLE]' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?(?:ROLE|INST|SYS)\])', '\1\\\2\3', 'g') || '[/ROLE]'
      || regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:ROLE|INST|SYS)\])', '\1\\\2\3', 'g') || '</s>') AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM f
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(so_far) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
