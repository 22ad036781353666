"""Chat formatting by multi-party perspective rotation (DataFrame operations only).

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; the loss mask covers the
assistant's own words and end marker. Rendering is by turn, so that no task ever
holds a whole conversation: the text of a rotation is its segments in the order
of `place`, which counts the turns of the conversation from 1. Places come from
one range-partitioned rank over all conversations, so a conversation with a third
of all rows is sorted by many tasks.

Names are reversible: letters and digits of ASCII and `-` stay, every other byte
of the UTF-8 text becomes `_` and two hex digits. Two speakers never share one.

Defined cases: a null role is an unnamed speaker: shown as user `_unknown`, which
no name can be, and never a participant. `system` turns stay system turns in
every rotation. Null text is empty. Turns with the same number stand in the order
of speaker, then text (nulls first); rows that agree in all these are alike, and
each is rendered. A conversation without participants gives no rows; an empty
table gives no rows. Null conversation ids form one conversation. Columns beyond
those named are dropped, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ranked

#: The markers of the rendered format.
START, END = "<|im_start|>", "<|im_end|>"
UNKNOWN = "_unknown"


def name_of(speaker: Column) -> Column:
    """The name of a speaker: `_`, `.`, `*` and blanks are first made escapes like those that url_encode makes of all other bytes."""
    escaped = F.replace(F.url_encode(speaker), F.lit("_"), F.lit("%5F"))
    for plain, code in ((".", "%2E"), ("*", "%2A"), ("+", "%20")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    return F.coalesce(F.replace(escaped, F.lit("%"), F.lit("_")), F.lit(UNKNOWN))


def rotate(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, place, out_role, name, segment, mask_start, mask_end, loss_chars.

    mask_start and mask_end are code points within the segment, end exclusive;
    both are 0 where nothing is learned. A marker inside a text is broken up
    (`<|` becomes `< |`), so a speaker cannot forge a turn.
    """
    lines = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(order).alias("turn"),
        F.col(role).alias("speaker"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"),
    )
    dealt = ranked(lines, "chat-turns", "conv_id", "turn", "speaker", "body", rank="at")
    first = dealt.groupBy(F.col("conv_id").alias("of")).agg(F.min("at").alias("first"))
    speakers = (
        turns.where(F.col(role).isNotNull() & (F.col(role) != system))
        .select(F.col(conversation).alias("of"), F.col(role).alias("perspective"))
        .distinct()
    )
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    name = name_of(F.col("speaker"))
    starts = first.join(speakers.withColumnRenamed("of", "conv"), F.col("of").eqNullSafe(F.col("conv"))).select("of", "first", "perspective")
    return (
        dealt.join(starts, F.col("conv_id").eqNullSafe(F.col("of")))
        .withColumn("place", F.col("at") - F.col("first") + 1)
        .withColumn("out_role", F.when(own, "assistant").when(F.col("speaker") == system, "system").otherwise("user"))
        .withColumn("name", F.when(F.col("out_role") == "user", name))
        .withColumn("head", F.concat(F.lit(START), "out_role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")))
        .select(
            "conv_id",
            "perspective",
            "turn",
            "place",
            "out_role",
            "name",
            F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
            F.when(own, F.length("head")).otherwise(0).cast("long").alias("mask_start"),
            F.when(own, F.length("head") + F.length("body") + len(END)).otherwise(0).cast("long").alias("mask_end"),
            F.when(own, F.length("body") + len(END)).otherwise(0).cast("long").alias("loss_chars"),
        )
    )


ROTATE_SQL = """
WITH lines AS (
  SELECT conv_id, turn, role AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body) AS place FROM lines),
speakers AS (
  SELECT DISTINCT conv_id AS cid, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'),
names AS (
  SELECT DISTINCT speaker AS who, array_to_string(list_transform(range(octet_length(encode(speaker))), lambda i:
    CASE WHEN regexp_matches(chr(CAST('0x' || substr(hex(encode(speaker)), CAST(2 * i + 1 AS BIGINT), 2) AS INT)), '^[A-Za-z0-9-]$')
      AND CAST('0x' || substr(hex(encode(speaker)), CAST(2 * i + 1 AS BIGINT), 2) AS INT) < 128
    THEN chr(CAST('0x' || substr(hex(encode(speaker)), CAST(2 * i + 1 AS BIGINT), 2) AS INT)) ELSE '_' || substr(hex(encode(speaker)), CAST(2 * i + 1 AS BIGINT), 2) END), '') AS shown
  FROM lines WHERE speaker IS NOT NULL),
shown AS (
  SELECT conv_id, turn, place, speaker, body, perspective,
         CASE WHEN speaker IS NOT DISTINCT FROM perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS out_role
  FROM placed JOIN speakers ON conv_id IS NOT DISTINCT FROM cid),
headed AS (
  SELECT s.*, CASE WHEN out_role = 'user' THEN coalesce(n.shown, '_unknown') END AS name FROM shown s LEFT JOIN names n ON who = speaker),
full_head AS (
  SELECT *, '<|im_start|>' || out_role || coalesce(' name=' || name, '') || chr(10) AS head FROM headed)
SELECT conv_id, perspective, turn, place, out_role, name, head || body || '<|im_end|>' || chr(10) AS segment,
       CAST(CASE WHEN out_role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS mask_start,
       CAST(CASE WHEN out_role = 'assistant' THEN length(head) + length(body) + 10 ELSE 0 END AS BIGINT) AS mask_end,
       CAST(CASE WHEN out_role = 'assistant' THEN length(body) + 10 ELSE 0 END AS BIGINT) AS loss_chars
FROM full_head
"""
