"""Chat formatting checked by a grammar round trip; DataFrame operations only.

A turn is rendered as ``### Role: text</turn>`` and a line break. The parser is deterministic: a turn ends at the first end
marker, its header is the first one, and a text holds neither. Control strings carry a place for backslashes,
``<\\/turn>`` and ``###\\ Role:``; escaping adds one backslash to each of them, unescaping takes one away, so that either is
the inverse of the other for any text. Each turn is rendered as it is first and read again; only where the recovered turn
differs, its text is escaped. What is read back from the output is compared with the source again (column ``identical``).

Defined results: NULL texts and roles count as empty; turns are ordered by turn, role and text; rows without a conv_id form
one conversation. Roles other than system, user and assistant are written percent-encoded. A conversation is one value by
contract (its digest covers all of it), so its turns meet in one row; rendering and checking are done per turn before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zephra.llm.catalog import query, table

END = "</turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = "System|User|Assistant|Role=[A-Za-z0-9.*_+%-]*"
_END_IN_TEXT = r"<(\\*)/turn>"
_HEAD_IN_TEXT = rf"###(\\*) ({_NAMES}):"
_HEAD = rf"^### ({_NAMES}): "


def header(role: Column) -> Column:
    name = F.concat(F.lit("Role="), F.url_encode(role))
    for r, n in ROLES.items():
        name = F.when(role == r, n).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _END_IN_TEXT, r"<\\$1/turn>"), _HEAD_IN_TEXT, r"###\\$1 $2:")


def unescape(text: Column) -> Column:
    one = F.regexp_replace(text, r"###\\(\\*) (" + _NAMES + "):", "###$1 $2:")
    return F.regexp_replace(one, r"<\\(\\*)/turn>", "<$1/turn>")


def parse(formatted: Column) -> Column:
    """Array of (role, text), the text still escaped, of a rendered conversation."""
    parts = F.split(formatted, END, -1)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        head = F.regexp_extract(part, _HEAD, 0)
        name = F.regexp_extract(part, _HEAD, 1)
        role = F.url_decode(F.regexp_replace(name, "^Role=", ""))
        for r, n in ROLES.items():
            role = F.when(name == n, r).otherwise(role)
        return F.struct(role.alias("role"), F.substr(part, F.length(head) + 1).alias("text"))

    return F.transform(turns, turn)


def rendered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, rendered): each turn as it is if it is recovered from that, else escaped."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_head", header(F.col("role")))
    plain = F.concat("_head", "text", F.lit(END))
    rows = rows.withColumn("_read", parse(plain))
    # More than one header or end marker would make two turns, or a turn within a turn.
    same = (
        (F.size("_read") == 1)
        & (F.get("_read", F.lit(0))["role"] == F.col("role"))
        & (unescape(F.get("_read", F.lit(0))["text"]) == F.col("text"))
        & ~F.col("text").rlike(f"### ({_NAMES}):")
        & ~F.col("text").contains("</turn>")
    )
    body = F.when(same, F.col("text")).otherwise(escape(F.col("text")))
    return rows.select("conv_id", "turn", "role", "text", F.concat("_head", body, F.lit(END)).alias("rendered"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, identical): the output, what is read back from it, and whether that is the source."""
    rows = rendered_turns(turns).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("_t")
    )
    source = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = rows.select("conv_id", source.alias("_source"), F.array_join(F.transform("_t", lambda t: t["rendered"]), "").alias("formatted"))
    back = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text")))
    out = out.withColumn("turns", back)
    return out.select("conv_id", "formatted", "turns", (F.col("turns") == F.col("_source")).alias("identical"))


def loss_text(turns: Column) -> Column:
    """Text under the loss mask: that of the assistant, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")


_PROBE = r"\### Assistant: </turn> ok"

_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length('### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
      ELSE 'Role=' || url_encode(role) END || ': ')
    + length(regexp_replace(regexp_replace(text, '<(\\*)/turn>', '<\\\1/turn>', 'g'),
        '###(\\*) (System|User|Assistant|Role=[A-Za-z0-9.*_+%-]*):', '###\\\1 \2:', 'g')) + 8 AS n FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, TRUE AS identical
FROM e GROUP BY conv_id
"""


@query("op9_chat_format", _SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(_PROBE).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    out = format_conversations(turns.unionByName(probe))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.withColumn("_loss", loss_text(F.col("turns")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
