"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation is taken once as the assistant: its own turns
become assistant turns and are trained on, everybody else speaks as a named user,
and system turns stay system turns.  One dialogue per participant comes out, with
the spans of characters to train on.

DataFrame functions only.  A conversation is gathered in parts of ``part_turns``
turn numbers, so no task holds more than a part; parts of one dialogue join end
to end in the order of ``part``, and ``offset`` tells where a part begins in it.

A mark of the format inside a text or a name is spelt with a blank (``< |im_end|>``),
and a name has no line ends, so nobody's words open or close a turn.

Defined results: a turn repeated exactly (same number, role and text) is rendered
once; turns of one number go by role, then text; a null text is an empty turn; a
null role speaks as ``unknown``; turns without a number come last, in parts -1 to
-256 by their MD5; rows with a null conv_id form one conversation.  A conversation
with system turns only has no participant and gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def harmless(c: Column) -> Column:
    """A text whose marks of the format are none any more."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def speaker_of(role: Column) -> Column:
    return F.translate(harmless(F.coalesce(role, F.lit("unknown"))), "\n\r", "  ")


def participants(turns: DataFrame) -> DataFrame:
    """``conv_id, perspective``: who speaks in each conversation, system aside."""
    return turns.select("conv_id", speaker_of(F.col("role")).alias("perspective")).where("perspective <> 'system'").distinct()


def messages(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Each turn once, with its speaker and the part of the conversation it is in."""
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker_of(F.col("role")).alias("speaker"), harmless(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    loose = -1 - F.conv(F.substring(F.md5(F.concat_ws(" ", "speaker", "text")), 1, 2), 16, 10).cast("long")
    part = F.coalesce(F.floor(F.col("turn") / F.lit(part_turns)), loose).cast("long")
    return said.select("conv_id", part.alias("part"), "turn", "speaker", "text").distinct()


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, perspective, part, offset, n_turns, dialogue, spans, n_trained``.

    ``spans`` are the ``[start, end)`` character ranges, within this part, of the
    assistant's text and its closing mark; with ``offset`` added, within the dialogue.
    """
    parts = (
        messages(turns, part_turns)
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), "speaker", "text"))).alias("said"))
    )
    heads = participants(turns).groupBy("conv_id").agg(F.array_sort(F.collect_set("perspective")).alias("heads")).withColumnRenamed("conv_id", "head_conv")

    def opened(speaker, perspective):
        return F.concat(
            F.lit(OPEN),
            F.when(speaker == perspective, F.lit("assistant")).when(speaker == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), speaker)),
            F.lit("\n"),
        )

    sizes = parts.select("conv_id", "part", F.transform("said", lambda t: F.struct(t["speaker"].alias("speaker"), F.length(t["text"]).alias("n"))).alias("said"))
    each = sizes.join(heads, F.col("conv_id").eqNullSafe(F.col("head_conv"))).select("conv_id", "part", "said", F.explode("heads").alias("perspective"))
    size = F.aggregate("said", F.lit(0).cast("long"), lambda n, t: n + F.length(opened(t["speaker"], F.col("perspective"))) + t["n"] + len(CLOSE))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy(F.col("part") < 0, F.abs("part")).rowsBetween(Window.unboundedPreceding, -1)
    begins = each.select("conv_id", "part", "perspective", size.alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)))  # no texts here
    begins = begins.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("k")).agg(F.array_sort(F.collect_list(F.struct("perspective", "offset"))).alias("seats"))
    seats = parts.join(begins, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("k"))).select("conv_id", "part", "said", F.explode("seats").alias("seat"))
    seats = seats.select("conv_id", "part", "said", "seat.perspective", "seat.offset")

    pieces = F.transform(
        "said",
        lambda t: F.struct(
            opened(t["speaker"], F.col("perspective")).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["speaker"] == F.col("perspective")).alias("own"),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state, piece):
        begin = state["at"] + F.length(piece["head"])
        end = begin + F.length(piece["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(piece["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    laid = seats.withColumn("pieces", pieces).withColumn("spans", F.aggregate("pieces", start, step)["spans"])
    return laid.select(
        "conv_id",
        "perspective",
        "part",
        "offset",
        F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("dialogue"),
        "spans",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_trained"),
    )


def op10_chat_perspectives(spark, sf_dir):
    """Every conversation of the table from every participant's seat."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(turns).withColumn("spans", spans)


CHAT_SQL = f"""
WITH m AS (
  SELECT DISTINCT conv_id, CAST(coalesce(floor(turn / {PART_TURNS}.0), -1 - CAST('0x' || substr(md5(speaker || ' ' || text), 1, 2) AS BIGINT)) AS BIGINT) AS part, turn, speaker, text
  FROM (SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13), '  ') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
s AS (
  SELECT m.conv_id, p.perspective, part, turn, speaker, text, speaker = perspective AS own,
         '{OPEN}' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system'
                          ELSE 'user name=' || speaker END || chr(10) AS head,
         text || '{CLOSE.strip()}' || chr(10) AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, CAST(sum(length(head) + length(body)) OVER (
              PARTITION BY conv_id, perspective, part ORDER BY turn NULLS LAST, speaker, text
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM s)
SELECT *, CAST(coalesce(sum(length(dialogue)) OVER (PARTITION BY conv_id, perspective ORDER BY part < 0, abs(part) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (
SELECT conv_id, perspective, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS LAST, speaker, text) AS dialogue,
       coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ',' ORDER BY upto)
                FILTER (WHERE own), '') AS spans,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_trained
FROM o GROUP BY conv_id, perspective, part)
"""
