r"""Chat formatting by prefix-target expansion, with DataFrame functions alone.

Every assistant turn becomes an example: all preceding turns are its context and only that reply is
trainable. A turn is written ``<s>role[INST] text [/INST]</s>``. Control strings inside a role or a
text get a backslash after their first character, and every backslash is doubled, so that no control
string is left in a text and the escape can be undone: ``<s>`` is written ``<\s>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read

OPEN, MID, END, CLOSE = "<s>", "[INST] ", " [/INST]", "</s>"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=(?<=<)/?s>|(?<=\[)/?INST\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MID), text, F.lit(END), F.lit(CLOSE))


def expand(conversations: DataFrame) -> DataFrame:
    """Training examples from rows (conv_id, turn, role, text).

    Returns conv_id, example (0, 1, ... within the conversation), n_context (turns before the target),
    text (context and target), loss_start and loss_chars (the span of ``text``, in code points, that is
    trainable; the reply's own text) and trainable. Turns that no reply follows come as a last row
    that is not trainable, so that no turn is lost; loss_chars is 0 there. Null roles and texts count as
    empty; rows of one conversation are ordered by turn (null first), role and text, repeats included;
    rows with a null conv_id form one conversation. An empty table gives no example.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # Raw texts order ties, so that the order is that of the input's values.
    parts = F.struct("turn", role.alias("role"), text.alias("raw"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("turns"))
    written = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("reply"), escape(t["role"]).alias("role"), escape(t["raw"]).alias("text")))
    turns = turns.select("conv_id", written.alias("turns"))
    turns = turns.select("conv_id", "turns", F.transform("turns", lambda t: turn_text(t["role"], t["text"])).alias("written"))
    sizes = F.transform("written", lambda w: F.length(w))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    turns = turns.select("conv_id", "turns", F.array_join("written", "").alias("whole"), ends.alias("ends"))
    n = F.size("turns")
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("turns", i)["reply"]) | (i == n - 1))
    rows = turns.select("conv_id", "turns", "whole", "ends", F.posexplode(at).alias("example", "n_context"))
    target, end = F.get("turns", F.col("n_context")), F.get("ends", F.col("n_context"))
    tail = len(END) + len(CLOSE)
    return rows.select(
        "conv_id", "example", "n_context", F.substring(F.col("whole"), F.lit(1), end).alias("text"),
        (end - tail - F.length(target["text"])).alias("loss_start"),
        F.when(target["reply"], F.length(target["text"])).otherwise(0).alias("loss_chars"),
        target["reply"].alias("trainable"),
    )


def read_back(text: Column) -> Column:
    """The turns of an example's text, as an array of (role, text) with the escapes undone."""
    pieces = F.split(text, CLOSE)  # the last piece is empty: no control string is left inside a turn
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(p: Column) -> Column:
        at = F.instr(p, MID)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - (len(OPEN) + 1))
        body = F.substring(p, at + len(MID), F.length(p) - (at + len(MID) - 1) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, parse)


def target_text(text: Column, loss_start: Column, loss_chars: Column) -> Column:
    return unescape(F.substring(text, loss_start + 1, loss_chars))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -1, read back from its examples."""
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = expand(rows)
    loss = F.when(F.col("trainable"), target_text(F.col("text"), F.col("loss_start"), F.col("loss_chars"))).otherwise("")
    digests = examples.select("conv_id", "example", loss.alias("loss"), "text").groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max_by("text", "example").alias("text"),
    )
    turns = digests.select("conv_id", "loss", "text", read_back(F.col("text")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || chr(0) || text, '[^\\]', '', 'g'))
    + (length(role || chr(0) || text) - length(regexp_replace(role || chr(0) || text, '</?s>', '', 'g'))
       - (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '</s>', '</s'))) ) // 3
    + (length(role || chr(0) || text) - length(regexp_replace(role || chr(0) || text, '\[/?INST\]', '', 'g'))
       - (length(role || chr(0) || text) - length(replace(role || chr(0) || text, '[/INST]', '[/INST'))) ) // 6 + 22 AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
