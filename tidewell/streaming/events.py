"""Event-time windows with watermarks, and a state per session for the mutable tail.  Windows are extras of this engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; rows later than the watermark are left out in a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of session windows."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tails(turns: DataFrame, grow: int = 14) -> DataFrame:
    """(session_id, frozen_to, tail_from, seen): after each batch, up to which round a session's cards are frozen.

    The state is two numbers a session.  Every `grow` rounds the tail moves on; a batch that fails leaves the state as it was.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frozen, seen = state.get if state.exists else (0, 0)
        for part in parts:
            seen = max(seen, int(part["round"].max()))
        while seen - frozen > grow:
            frozen += grow
        state.update((frozen, seen))
        yield pd.DataFrame([(int(key[0]), frozen, frozen + 1, seen)], columns=["session_id", "frozen_to", "tail_from", "seen"])

    out, kept = "session_id long, frozen_to long, tail_from long, seen long", "frozen long, seen long"
    return turns.groupBy("session_id").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
