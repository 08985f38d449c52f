"""One load of files of every family, with one numbering pass over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import canonical_id
from tidewell.operators.rounds import assign_rounds
from tidewell.sources import envelopes as e
from tidewell.sources import journal as j

COLUMNS = ["session_id", "source_uuid", "role", "text", "ts", "major", "minor", "file"]


def candidates(files: DataFrame, room_of_route: dict[str, str]) -> DataFrame:
    """Turn candidates of files (path, value): journals, strict envelopes, exports, transcripts and plain arrays.

    session_id and source_uuid are texts; major and minor order a session's rows within its family's own order.
    """
    named = files.withColumn("family", e.family())
    # The value of another family is null, and not only filtered: a strict parser may run before a filter.
    of = lambda family: named.where(F.col("family") == family).select("path", F.when(F.col("family") == family, F.col("value")).alias("value"))
    ts = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz").alias("ts")
    place = lambda major, minor: [major.cast("long").alias("major"), minor.cast("long").alias("minor"), F.col("path").alias("file")]
    lines = of("journal").select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).where(F.col("value").rlike(r"\S"))
    said = j.messages(j.parse_lines(lines))
    parts = [said.select(canonical_id("session", F.lit("journal"), F.col("sessionId")).alias("session_id"), F.col("uuid").alias("source_uuid"), "role", "text", ts(F.col("timestamp")), *place(F.lit(1), F.col("line_no")))]
    strict = e.normalized_messages(of("normalized"), room_of_route)
    parts.append(strict.select("session_id", "source_uuid", "role", "text", F.col("ts").cast("timestamp_ntz").alias("ts"), *place(F.lit(1), F.col("major"))))
    exported = e.export_messages(of("export"))
    chosen = exported.join(e.snapshot_select(exported), ["session", "path", "chat_index"], "left_semi")
    parts.append(chosen.select(canonical_id("session", F.lit("export"), F.col("session")).alias("session_id"), F.col("uuid").alias("source_uuid"), "role", "text", ts(F.col("created_at")), *place(F.col("chat_index"), F.col("index"))))
    told = e.transcript_messages(of("transcript"))
    parts.append(told.select(canonical_id("session", F.lit("transcript"), F.col("path")).alias("session_id"), canonical_id("message", F.lit("transcript"), F.col("path"), F.col("index").cast("string")).alias("source_uuid"), "role", "text", F.lit(None).cast("timestamp_ntz").alias("ts"), *place(F.col("round"), F.col("index"))))
    plain = e.legacy_messages(of("legacy"))
    parts.append(plain.select("session_id", "source_uuid", "role", "text", F.col("ts").cast("timestamp_ntz").alias("ts"), *place(F.coalesce("round", F.lit(0)), F.col("index"))))
    out = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*COLUMNS))
    return out


def load(files: DataFrame, room_of_route: dict[str, str]) -> DataFrame:
    """The turns of all files, numbered once."""
    return assign_rounds(candidates(files, room_of_route))
