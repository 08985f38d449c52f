"""Chat formatting by multi-party perspective rotation (DataFrame functions only).

For every participant of a conversation the dialogue is rendered once, with that speaker as
`assistant`, all other speakers as users with a name, and masks over the assistant's own
content and end mark: `mask_spans` lists `start:length` in code points of `rendered`.  `system` is no
participant; its turns are rendered as system messages in every perspective.

Every message is rendered, as often as it occurs, and every participant has the whole dialogue.  So that neither a
very long conversation nor a hot or null conv_id is ever gathered in one row, a dialogue comes in rows that follow each
other: by segment (SEGMENT_TURNS turn numbers), and within a segment of more messages than that by part.  `starts_at` is a
row's place in the whole rendering, in code points, so the rows' texts joined by (segment, part) are the dialogue, and
starts_at + start the place of a mask.  A conversation of up to SEGMENT_TURNS turn numbers and messages is one row a participant.
Equal rows are folded to a count before the shuffle; a group is ranked by a window, which spills, and never collected but in parts.

Defined cases: a null or blank role is the speaker `unknown`; a null text is an empty message;
messages without a turn come first, in segment NO_TURN; turns that tie go by role, then text; a null
conv_id is one conversation; a conversation of system turns only gives no row; `<|` in a
text or a name becomes `< |`, so that content can't forge a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.llm.common import read

SEGMENT_TURNS = 256
#: The segment of messages without a turn.
NO_TURN = -(1 << 62)


def rotate_perspectives(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """(conv_id, segment, part, participant, n_messages, starts_at, rendered, mask_spans) from conv_id, turn, role, text."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    speaker = F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("unknown")).otherwise(clean(F.trim("role")))
    segment = F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(NO_TURN)).cast("long")
    folded = (
        turns.select("conv_id", segment.alias("segment"), "turn", speaker.alias("speaker"), clean(F.coalesce("text", F.lit(""))).alias("body"))
        .groupBy("conv_id", "segment", "turn", "speaker", "body").agg(F.count("*").alias("n"))
    )
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id", "segment").orderBy("turn", "speaker", "body").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A message of n copies lies in the parts of its first to its last copy, in each as often as copies fall there.
    ranked = folded.withColumn("before", before).withColumn("part", F.explode(F.sequence(F.floor(F.col("before") / segment_turns), F.floor((F.col("before") + F.col("n") - 1) / segment_turns))))
    inside = F.least(F.col("before") + F.col("n"), (F.col("part") + 1) * segment_turns) - F.greatest("before", F.col("part") * segment_turns)
    placed = ranked.withColumn("n", inside.cast("int"))
    message = F.struct("turn", "speaker", "body", "n")
    dialogue = placed.groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(message)).alias("said"))
    dialogue = dialogue.withColumn("said", F.flatten(F.transform("said", lambda m: F.array_repeat(m, m["n"]))))
    starts = _starts(placed)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")) & (F.col("part") == F.col("_part"))
    seen = dialogue.join(starts, same).drop("_conv", "_segment", "_part")

    own = lambda m: m["speaker"] == F.col("participant")
    role = lambda m: F.when(m["speaker"] == "system", "system").when(own(m), "assistant").otherwise(F.concat(F.lit("user name="), m["speaker"]))
    parts = F.transform(
        "said",
        lambda m: F.struct(F.concat(F.lit("<|im_start|>"), role(m), F.lit("\n")).alias("head"), F.concat(m["body"], F.lit("<|im_end|>")).alias("body"), own(m).alias("train")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def walk(state, part):
        begins = state["at"] + F.length(part["head"])
        span = F.concat_ws(":", begins, F.length(part["body"]))
        return F.struct((begins + F.length(part["body"]) + 1).alias("at"), F.when(part["train"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return seen.withColumn("parts", parts).select(
        "conv_id", "segment", "part", "participant", F.size("said").alias("n_messages"), "starts_at",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("parts", start, walk, lambda s: s["spans"]), ",").alias("mask_spans"),
    )


def _starts(placed: DataFrame) -> DataFrame:
    """(_conv, _segment, _part, participant, starts_at) for every participant of every conversation, from lengths alone."""
    name = F.length("speaker") + F.length(F.lit("user name="))
    role = F.when(F.col("speaker") == "system", F.lit(len("system"))).otherwise(name)
    length = F.col("n") * (len("<|im_start|>") + role + 1 + F.length("body") + len("<|im_end|>") + 1)
    said = placed.groupBy("conv_id", "segment", "part", "speaker").agg(F.sum(length).alias("length"), F.sum(F.col("n") * (len("assistant") - name)).alias("own"))
    rows = said.groupBy("conv_id", "segment", "part").agg(F.sum("length").alias("length"))
    people = said.where("speaker <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant")).distinct()
    every = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = said.select(F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), F.col("part").alias("_part"), F.col("speaker").alias("_speaker"), "own")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")) & (F.col("part") == F.col("_part")) & (F.col("participant") == F.col("_speaker"))
    lengths = every.join(own, same, "left").select("conv_id", "segment", "part", "participant", (F.col("length") + F.coalesce("own", F.lit(0))).alias("length"))
    before = F.sum("length").over(W.partitionBy("conv_id", "participant").orderBy("segment", "part").rowsBetween(W.unboundedPreceding, -1))
    return lengths.select(
        F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), F.col("part").alias("_part"), "participant", F.coalesce(before, F.lit(0)).cast("long").alias("starts_at")
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH m AS (
  SELECT conv_id, CASE WHEN turn IS NULL THEN -4611686018427387904 ELSE CAST(floor(turn / 256.0) AS BIGINT) END AS segment, turn,
    CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE replace(trim(role), '<|', '< |') END AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, speaker, body) - 1) // 256 AS part FROM m),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM m WHERE speaker <> 'system'),
parts AS (
  SELECT n.conv_id, n.segment, n.part, participant, turn, speaker, body, speaker = participant AS train,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = participant THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM n JOIN people ON n.conv_id IS NOT DISTINCT FROM people.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS k, coalesce(sum(length(head) + length(body) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM parts WINDOW w AS (PARTITION BY conv_id, participant ORDER BY segment, part, turn NULLS FIRST, speaker, body)),
based AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, participant, segment, part) AS starts_at FROM placed)
SELECT conv_id, segment, part, participant, CAST(count(*) AS INTEGER) AS n_messages, CAST(min(starts_at) AS BIGINT) AS starts_at,
  string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg((pos - starts_at + length(head)) || ':' || (length(body) + 10), ',' ORDER BY k) FILTER (WHERE train), '') AS mask_spans
FROM based GROUP BY conv_id, segment, part, participant
"""

QUERIES = {"op9_chat_formatting": op9_chat_formatting}
ORACLES = {"op9_chat_formatting": ORACLE}
