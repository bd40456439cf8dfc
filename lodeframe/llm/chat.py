"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only
that reply is trainable. Turns after the last reply (and conversations without one) become a last
example without a trainable part, so that the output holds every turn.

Template: ``[TURN]role[TEXT]text[/TURN]`` for each turn. Inside roles and texts ``&``, ``<`` and
``[`` are written ``&amp;``, ``&lt;`` and ``&#91;``: no text can then hold one of the template's
strings, or ``</s>``, ``[INST]`` and their like, and ``unescaped`` gives the text back exactly.

Built-in functions only; one shuffle, on the conversation. A null text or role is empty; a null
conversation id is a conversation of its own; turns are in order of number, nulls first, then role,
then text; repeated rows are repeated turns; an empty table gives no example; other columns are not
looked at. An example is one row, so a conversation's examples must fit its executor's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CONTROL = "</s>[INST] ok [/INST]"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    return F.concat(F.lit("[TURN]"), escaped(role), F.lit("[TEXT]"))


def examples(turns: DataFrame) -> DataFrame:
    """Per example: conv_id, example (from 0), formatted, loss_start and loss_end (code points of
    ``formatted``; equal if nothing is trainable), last (true for a conversation's last example)."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    parts = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), F.concat(_head(t["role"]), escaped(t["text"]), F.lit("[/TURN]")).alias("whole"), F.length(_head(t["role"])).alias("head"))).alias("parts"),
    )
    numbers = F.sequence(F.lit(1), F.size("parts"))
    ends = parts.select("conv_id", "parts", F.filter(numbers, lambda i: F.get("parts", i - 1)["reply"] | (i == F.size("parts"))).alias("ends"))
    each = ends.select("conv_id", "parts", F.size("ends").alias("n"), F.posexplode("ends").alias("example", "end"))
    context = F.array_join(F.transform(F.slice("parts", 1, F.col("end") - 1), lambda p: p["whole"]), "")
    final = F.get("parts", F.col("end") - 1)
    cut = each.select("conv_id", "example", (F.col("example") == F.col("n") - 1).alias("last"), context.alias("context"), final.alias("final"))
    begin = F.length("context") + F.col("final.head")
    stop = F.length("context") + F.length("final.whole") - len("[/TURN]")
    return cut.select(
        "conv_id",
        "example",
        F.concat("context", "final.whole").alias("formatted"),
        begin.cast("bigint").alias("loss_start"),
        F.when(F.col("final.reply"), stop).otherwise(begin).cast("bigint").alias("loss_end"),
        F.col("final.reply").alias("trainable"),
        "last",
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    bodies = F.filter(F.split(formatted, r"\[/TURN\]", -1), lambda b: b != "")
    cut = F.transform(bodies, lambda b: F.split(F.substring(b, len("[TURN]") + 1, 2**31 - 1), r"\[TEXT\]", 2))
    return F.transform(cut, lambda c: F.struct(unescaped(c[0]).alias("role"), unescaped(c[1]).alias("text")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    made = examples(given.unionByName(planted))
    target = F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    back = made.select(
        "conv_id",
        F.struct("example", F.when(F.col("trainable"), unescaped(target)).otherwise(F.lit("")).alias("loss")).alias("e"),
        F.when(F.col("last"), read_turns(F.col("formatted"))).alias("turns"),
        F.length("formatted").cast("bigint").alias("chars"),
    )
    # the partitioning by conversation still holds: no second shuffle
    whole = back.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("es"), F.first("turns", ignorenulls=True).alias("turns"), F.sum("chars").alias("formatted_chars"))
    read = whole.select("conv_id", "turns", F.array_join(F.transform("es", lambda e: e["loss"]), "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = """
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('[TURN][TEXT][/TURN]') + length(role) + length(text)
    + 4 * (length(role || text) - length(replace(role || text, '&', '')))
    + 3 * (length(role || text) - length(replace(role || text, '<', '')))
    + 4 * (length(role || text) - length(replace(role || text, '[', ''))) AS chars
  FROM given
), prefixed AS (
  SELECT *, sum(chars) OVER w AS prefix_chars, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix_chars) FILTER (role = 'assistant' OR nth = n) AS BIGINT) AS formatted_chars
FROM prefixed GROUP BY conv_id
"""
