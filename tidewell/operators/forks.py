"""Sessions that grew out of others, and sessions that have something new to summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fork_pairs(turns: DataFrame, min_shared: int = 2) -> DataFrame:
    """(parent, child, shared, parent_round, child_round): sessions that share messages; the child is the later id."""
    a = turns.select("source_uuid", F.col("session_id").alias("parent"), F.col("round").alias("pr"))
    b = turns.select("source_uuid", F.col("session_id").alias("child"), F.col("round").alias("cr"))
    pairs = a.join(b, "source_uuid").where("parent < child")
    return pairs.groupBy("parent", "child").agg(F.count("*").alias("shared"), F.max("pr").alias("parent_round"), F.max("cr").alias("child_round")).where(F.col("shared") >= min_shared)


def session_forks(turns: DataFrame, min_shared: int = 2) -> DataFrame:
    """For each child the parent with most shared messages, then most turns, then the greater id."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    pairs = fork_pairs(turns, min_shared).join(sizes.select(F.col("session_id").alias("parent"), F.col("n").alias("parent_turns")), "parent")
    best = pairs.groupBy("child").agg(F.max(F.struct("shared", "parent_turns", "parent", "parent_round", "child_round")).alias("b")).select("child", "b.*")
    return best.join(sizes.select(F.col("session_id").alias("child"), F.col("n").alias("child_turns")), "child").select(
        "child", "parent", "shared", "parent_round", "child_round", (F.col("child_round") + 1).alias("delta_start"), F.round(F.col("shared") / F.col("child_turns"), 6).alias("ratio")
    )


def fork_delta(turns: DataFrame, forks: DataFrame) -> DataFrame:
    """(child, delta_turns, delta_rounds): what a child has beyond its fork."""
    rows = turns.join(forks.select(F.col("child").alias("session_id"), "child_round"), "session_id").where("round > child_round")
    return rows.groupBy(F.col("session_id").alias("child")).agg(F.count("*").alias("delta_turns"), F.countDistinct("round").alias("delta_rounds"))


def sessions_needing_update(turns: DataFrame, cards: DataFrame, forks: DataFrame, min_rounds: int = 2) -> DataFrame:
    """(session_id, max_round, covered, effective_rounds): sessions with rounds beyond their last card or their fork.

    A session without cards needs min_rounds effective rounds (of a child: those beyond its fork), and is left
    out while a child of it has a card that begins at or before the fork.
    """
    stats = turns.groupBy("session_id").agg(F.max("round").alias("max_round"), F.countDistinct("round").alias("n_rounds"), F.max("ts").alias("last_at"))
    covered = cards.groupBy("session_id").agg(F.max("turn_end").alias("last_end"))
    own = forks.select(F.col("child").alias("session_id"), F.col("child_round"), F.col("delta_start"))
    delta = fork_delta(turns, forks).select(F.col("child").alias("session_id"), "delta_rounds")
    taken = forks.select(F.col("parent").alias("session_id"), "child", "child_round").join(cards.select(F.col("session_id").alias("child"), "turn_start"), "child").where("turn_start <= child_round").select("session_id").distinct().withColumn("taken", F.lit(True))
    rows = stats.join(covered, "session_id", "left").join(own, "session_id", "left").join(delta, "session_id", "left").join(taken, "session_id", "left")
    effective = F.when(F.col("child_round").isNotNull(), F.coalesce("delta_rounds", F.lit(0))).otherwise(F.col("n_rounds"))
    done = F.coalesce("last_end", "child_round", F.lit(0))
    wanted = (F.col("max_round") > done) & (F.col("last_end").isNotNull() | (effective >= min_rounds)) & ~(F.col("last_end").isNull() & F.coalesce("taken", F.lit(False)))
    return rows.where(wanted).select("session_id", "max_round", done.cast("long").alias("covered"), effective.cast("long").alias("effective_rounds"))


def uncovered_nodes(nodes: DataFrame, card_nodes: DataFrame) -> DataFrame:
    """(owner, n_uncovered): nodes that no card holds."""
    free = nodes.join(card_nodes.select(F.col("source_uuid").alias("node_id")), "node_id", "left_anti")
    return free.groupBy("owner").agg(F.count("*").alias("n_uncovered"))


def branch_coverage(branch_turns: DataFrame, card_nodes: DataFrame, min_rounds: int = 1) -> DataFrame:
    """(branch, own_rounds, own_uncovered) of branches with an own node that no card holds and enough own rounds."""
    held = card_nodes.select(F.col("source_uuid").alias("node_id")).distinct().withColumn("held", F.lit(True))
    own = branch_turns.where("NOT is_context").join(held, "node_id", "left")
    grouped = own.groupBy("branch").agg(F.countDistinct("round").alias("own_rounds"), F.sum(F.col("held").isNull().cast("long")).alias("own_uncovered"))
    return grouped.where((F.col("own_uncovered") > 0) & (F.col("own_rounds") >= min_rounds))
