"""Multi-party perspective rotation of dialogues, with DataFrame operations only.

Every participant of a dialogue gets a rendering in which that speaker is the
assistant and the others are users with their names; system turns stay system
turns in every perspective. The mask marks what the assistant says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Role names whose turns frame the dialogue and are nobody's perspective.
SYSTEM = ("system",)
OPEN, CLOSE, NAMED = "<|im_start|>", "<|im_end|>\n", " name="


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple = SYSTEM) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, rendered, mask_spans and n_masked_chars for each dialogue and participant.

    Turns are ordered by number (null first), then speaker and text; repeated
    rows are repeated turns. A null or blank speaker takes part as "unknown", a
    null text is empty, rows without a conversation id are one dialogue.
    Markers inside texts are taken apart with a zero-width space, so that a text
    cannot open a turn of its own. mask_spans has start:end code point offsets
    of what the assistant says, comma-joined, ends exclusive; empty turns have
    empty spans. A dialogue of system turns only has no participant and no row.
    """
    who = F.coalesce(F.when(F.trim(speaker) != "", F.trim(speaker)), F.lit("unknown"))
    # a marker is "<|" and more: no text or name may hold it, nor may a name hold what ends a header
    said = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("<\u200b|"))
    name = F.translate(F.replace(who, F.lit("<|"), F.lit("<\u200b|")), "\n", " ")
    slim = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), name.alias("who"), said.alias("said"))
    framing = F.col("who").isin(*system)
    # headers as everyone but the speaker sees them
    slim = slim.withColumn("head", F.concat(F.lit(OPEN), F.when(framing, F.lit("system")).otherwise(F.concat(F.lit("user" + NAMED), "who")), F.lit("\n")))
    mine = f"{OPEN}assistant\n"
    # In a speaker's own rendering, its text begins after all turns before it, of which its own have another header.
    # Both windows and the grouping share one exchange by conversation.
    order = ["turn", "who", "said"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "who").orderBy("turn", "said")
    at = F.coalesce(F.sum(F.length("head") + F.length("said") + len(CLOSE)).over(before), F.lit(0)) + (F.row_number().over(own) - 1) * (len(mine) - F.length("head")) + len(mine)
    slim = slim.withColumn("span", F.struct(at.cast("long").alias("s"), (at + F.length("said")).cast("long").alias("e")))
    xs = F.sort_array(F.collect_list(F.struct("turn", "who", "said", "span", "head")))
    whole = slim.groupBy("conv_id").agg(xs.alias("xs"), F.collect_set(F.when(~framing, F.col("who"))).alias("speakers"))
    each = whole.select("conv_id", "xs", F.explode("speakers").alias("speaker"))
    lines = F.transform("xs", lambda x: F.concat(F.when(x["who"] == F.col("speaker"), F.lit(mine)).otherwise(x["head"]), x["said"], F.lit(CLOSE)))
    spans = F.transform(F.filter("xs", lambda x: x["who"] == F.col("speaker")), lambda x: x["span"])
    out = each.select("conv_id", "speaker", F.size("xs").cast("long").alias("n_turns"), F.array_join(lines, "").alias("rendered"), spans.alias("spans"))
    return out.select(
        "conv_id",
        "speaker",
        "n_turns",
        F.size("spans").cast("long").alias("n_own"),
        "rendered",
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias("mask_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_masked_chars"),
    )


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """Every perspective of every conversation."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, turn,
    replace(replace(coalesce(CASE WHEN trim(role) <> '' THEN trim(role) END, 'unknown'), '<|', '<' || chr(8203) || '|'), chr(10), ' ') AS who,
    replace(coalesce(text, ''), '<|', '<' || chr(8203) || '|') AS said
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) AS i FROM t
), p AS (
  SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'
), r AS (
  SELECT p.conv_id, p.speaker, n.i, n.said, n.who = p.speaker AS own,
    '<|im_start|>' || CASE WHEN n.who = p.speaker THEN 'assistant' WHEN n.who = 'system' THEN 'system' ELSE 'user name=' || n.who END || chr(10) AS head
  FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM r
)
SELECT conv_id, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || said || '<|im_end|>' || chr(10), '' ORDER BY i) AS rendered,
  coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(said) AS BIGINT), ',' ORDER BY i) FILTER (own), '') AS mask_spans,
  CAST(sum(CASE WHEN own THEN length(said) ELSE 0 END) AS BIGINT) AS n_masked_chars
FROM s GROUP BY conv_id, speaker
"""
