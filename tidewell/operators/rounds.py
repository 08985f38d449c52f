"""Turns: duplicates, rounds, clean-up of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def dedup_turns(candidates: DataFrame) -> DataFrame:
    """One row a (session_id, source_uuid): the least (major, minor)."""
    w = W.partitionBy("session_id", "source_uuid").orderBy("major", "minor")
    return candidates.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def assign_rounds(candidates: DataFrame) -> DataFrame:
    """(session_id, source_uuid, role, text, ts, ord, round, message_seq): a user's message, or the first of a session, opens a round.

    Both windows share the session's partitioning, so there is one shuffle after the duplicates' one.
    """
    order = W.partitionBy("session_id").orderBy("major", "minor", "source_uuid")
    placed = dedup_turns(candidates).withColumn("ord", F.row_number().over(order).cast("long"))
    opens = F.when((F.col("role") == "user") | (F.col("ord") == 1), 1).otherwise(0)
    numbered = placed.withColumn("round", F.sum(opens).over(W.partitionBy("session_id").orderBy("ord")).cast("long"))
    seq = F.row_number().over(W.partitionBy("session_id", "round").orderBy("ord")).cast("long")
    return numbered.select("session_id", "source_uuid", "role", "text", "ts", "ord", "round", seq.alias("message_seq"))


def completed_rounds(path: DataFrame, path_id: str = "branch") -> DataFrame:
    """Rows of rounds that an assistant answered; path: path_id, pos, role.  A user's message counts only if an assistant follows before the next user."""
    group = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy(path_id).orderBy("pos"))
    grouped = path.withColumn("_g", group).where("_g > 0")
    last_user = F.max(F.when(F.col("role") == "user", F.col("pos"))).over(W.partitionBy(path_id, "_g"))
    answered = F.max((F.col("role") == "assistant").cast("int")).over(W.partitionBy(path_id, "_g")) == 1
    return grouped.withColumn("_u", last_user).withColumn("_a", answered).where("_a AND pos >= _u").drop("_g", "_u", "_a")


def session_replay(turns: DataFrame, session_id: int | None = None) -> DataFrame:
    rows = turns if session_id is None else turns.where(F.col("session_id") == session_id)
    return rows.select("session_id", "round", "message_seq", "role", "text", "ts")


def turn_stats(turns: DataFrame) -> DataFrame:
    """(session_id, n_turns, n_rounds, max_round, first_at, last_at)."""
    return turns.groupBy("session_id").agg(
        F.count("*").alias("n_turns"), F.countDistinct("round").alias("n_rounds"), F.max("round").alias("max_round"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )
