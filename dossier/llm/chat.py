"""Chat formatting by perspective rotation: every participant's view of a conversation, with its loss mask.

Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut, spread

#: Turn numbers, and turns, in one row of the output at most, so that no conversation has to fit in a task.
PART_TURNS = 256


def speaker_name(role: Column) -> Column:
    """A role as it stands in a head: unknown for null, line breaks as spaces, and marks broken by a space."""
    line = F.regexp_replace(F.coalesce(role, F.lit("unknown")), r"[\n\r]", " ")
    return F.replace(F.replace(line, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def _in_pieces(turns: DataFrame, part_turns: int) -> DataFrame:
    """Distinct turns (conv_id, turn, speaker, body) with part, piece and times: how often a piece of the part has them.

    A piece has part_turns turns of a part, in their order. The place of a turn is counted over slices of all turns in
    order, so that neither a conversation nor a turn number has to be in one task.
    """
    turn = F.col("turn").cast("long")
    part = F.floor(turn / part_turns).alias("part")
    speaker = speaker_name(F.col("role")).alias("speaker")
    body = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>")).alias("body")
    order = ("turn", "speaker", "body")
    copies = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.lit(1)).otherwise(F.count("*")).cast("long")
    rows = turns.select("conv_id", part, turn.alias("turn"), speaker, body).groupBy("conv_id", "part", *order).agg(copies.alias("copies"))
    rows = cut(rows.repartitionByRange("conv_id", "part", *order).withColumn("slice", F.spark_partition_id()), "chat-slices")
    before = lambda by: F.coalesce(F.sum("copies").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slices = rows.groupBy("conv_id", "part", "slice").agg(F.sum("copies").alias("copies"))
    slices = slices.withColumn("skipped", before(Window.partitionBy("conv_id", "part").orderBy("slice"))).select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.col("slice").alias("_slice"), "skipped")
    rows = rows.withColumn("at", before(Window.partitionBy("slice", "conv_id", "part").orderBy(*order)))
    same = (F.col("slice") == F.col("_slice")) & F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part"))
    rows = rows.join(slices, same).withColumn("at", F.col("at") + F.col("skipped")).withColumn("to", F.col("at") + F.col("copies"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.expr(f"at div {part_turns}"), F.expr(f"(to - 1) div {part_turns}"))))
    times = F.least("to", (F.col("piece") + 1) * part_turns) - F.greatest("at", F.col("piece") * part_turns)
    return cut(rows.select("conv_id", "part", "piece", *order, times.cast("int").alias("times")), "chat-pieces")


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Dialogues of turns (conv_id, turn, role, text), one for every participant of every conversation.

    In a participant's dialogue its own turns are the assistant's and all others those of users with their names. The
    mask has the assistant's texts with their end marks, as spans of characters (code points) of the dialogue.

    Returns conv_id, perspective, part, start_char, n_turns, dialogue, n_masked and mask_spans ("from-to", the end not
    included, divided by spaces). Turns are in parts by number, `part_turns` numbers each, so a long conversation is
    several rows, whose start_char says where the part begins; conversations of fewer turns have one row. A part of more
    turns than that, as numbers repeat or are missing, is several rows too, of `part_turns` turns each but the last.
    A null role is named unknown; a null text is empty; turns without a number come last, in a part of their own;
    equal numbers are ordered by role and text. Equal rows with a conv_id and a number are one turn, others are turns of
    their own. Marks inside a text or a name are broken by a space, and line breaks in a name are spaces, so no text or
    name opens a turn; names that are then equal are one participant. A text may be empty or of any length: it is in one
    row whole. A null conv_id is a conversation of its own. Other columns are ignored. No turns: no rows.
    """
    rows = _in_pieces(turns, part_turns)
    views = turns.select(F.col("conv_id").alias("_conv"), speaker_name(F.col("role")).alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    segments = rows.join(views, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        "perspective",
        "part",
        "piece",
        F.struct("turn", "speaker", "body", head.alias("head"), own.alias("own"), "times").alias("s"),
    )
    row = ("conv_id", "perspective", "part", "piece")
    parts = segments.groupBy(*row).agg(F.sort_array(F.collect_list("s")).alias("s"))
    parts = parts.withColumn("s", F.flatten(F.transform("s", lambda x: F.array_repeat(x, x["times"]))))
    parts = parts.withColumn("dialogue", F.array_join(F.transform("s", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), ""))
    n_chars = F.col("s.times") * (F.char_length("s.head") + F.char_length("s.body") + 1).cast("long")
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("part").asc_nulls_last(), "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.groupBy(*row).agg(F.sum(n_chars).alias("n")).select(*(F.col(c).alias(f"{c}_") for c in row), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start_char"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in row]
    parts = parts.join(starts, same)

    def walk(state, x):
        begin = state["at"] + F.char_length(x["head"])
        end = begin + F.char_length(x["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(
            (end + 1).alias("at"),
            (state["masked"] + F.when(x["own"], end - begin).otherwise(F.lit(0))).cast("long").alias("masked"),
            F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    none = F.struct(F.col("start_char").alias("at"), F.lit(0).cast("long").alias("masked"), F.array().cast("array<string>").alias("spans"))
    return parts.withColumn("w", F.aggregate("s", none, walk)).select(
        "conv_id", "perspective", "part", "start_char", F.size("s").cast("long").alias("n_turns"), "dialogue", F.col("w.masked").alias("n_masked"), F.array_join("w.spans", " ").alias("mask_spans")
    )


def op5_perspective_chats(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's perspective."""
    return perspectives(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP5_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn,
    replace(replace(regexp_replace(coalesce(role, 'unknown'), '[\n\r]', ' ', 'g'), '<|', '< |'), '|>', '| >') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t
), s AS (
  SELECT t.conv_id, perspective, turn // 256 AS part, turn, speaker, text, speaker = perspective AS own,
    CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head,
    text || '<|end|>' AS body
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), o AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER w)::BIGINT - length(body) - 1 AS b
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, body ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, perspective, part, min(b - length(head))::BIGINT AS start_char, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn, speaker, body) AS dialogue,
  coalesce(sum(length(body)) FILTER (own), 0)::BIGINT AS n_masked,
  coalesce(string_agg(b || '-' || (b + length(body)), ' ' ORDER BY turn, speaker, body) FILTER (own), '') AS mask_spans
FROM o GROUP BY conv_id, perspective, part
"""
