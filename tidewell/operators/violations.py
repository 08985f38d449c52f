"""Rules that a batch must keep; each gives rows (rule, key), and an ingest goes on only without any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.columns import blank

KINDS = ("message", "tool", "checkpoint", "event")


def _named(rows: DataFrame, rule: str, key: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(rows: DataFrame, key: str, rule: str = "duplicate") -> DataFrame:
    return _named(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), rule, key)


def conflicting(rows: DataFrame, key: str, fields: list[str], rule: str = "conflict") -> DataFrame:
    """Keys under which a field has several values (nulls count as a value)."""
    return _named(rows.groupBy(key).agg(F.size(F.collect_set(F.struct(*fields))).alias("n")).where("n > 1"), rule, key)


def changed(old: DataFrame, new: DataFrame, key: str, fields: list[str], rule: str = "changed") -> DataFrame:
    """Stored rows are immutable: keys whose fields differ from the stored ones, nulls compared safely."""
    right = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    differ = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    return _named(old.join(right, key).where(differ), rule, key)


def missing_parent(nodes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Parents that are neither in the batch nor stored."""
    known = nodes.select(F.col("node_id").alias("parent_id"))
    known = known if stored is None else known.unionByName(stored.select(F.col("node_id").alias("parent_id")))
    return _named(nodes.where("parent_id IS NOT NULL").join(known, "parent_id", "left_anti"), "missing parent", "node_id")


def bad_shape(nodes: DataFrame) -> DataFrame:
    """A message has role and text, other kinds have neither; unknown kinds."""
    message = F.col("kind") == "message"
    wrong = ~F.col("kind").isin(*KINDS) | (message & (~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)) | blank(F.col("text")))) | (~message & F.col("role").isNotNull())
    return _named(nodes.where(wrong), "shape", "node_id")


def bad_sequence(rows: DataFrame, session: str, sequence: str) -> DataFrame:
    negative = _named(rows.where(F.col(sequence) < 0), "negative sequence", session)
    twice = _named(rows.groupBy(session, sequence).agg(F.count("*").alias("n")).where("n > 1"), "sequence twice", session)
    return negative.unionByName(twice)


def unknown_room(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """Rows whose (source, room) the policy doesn't allow; rooms: source, room."""
    return _named(rows.join(rooms, ["source", "room"], "left_anti"), "unknown room", "room")


def with_room(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """rows (source, route, and a room that may be null) with the room that the policy (source, route, room) gives: by source and route, or the
    row's own room where the policy names it for that source; else null, which `unrouted` lists."""
    exact = policy.select("source", "route", F.col("room").alias("_routed"))
    allowed = policy.select("source", F.col("room").alias("_own")).distinct()
    joined = rows.join(exact, ["source", "route"], "left").join(allowed, (rows["source"] == allowed["source"]) & (rows["room"] == allowed["_own"]), "left").drop(allowed["source"])
    return joined.withColumn("room", F.coalesce("_routed", "_own")).drop("_routed", "_own")


def unrouted(rows: DataFrame) -> DataFrame:
    return _named(rows.where("room IS NULL"), "no room", "route")


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, before, after) of counts (name, n) that a maintenance run has changed; a count that only one side has is a change."""
    both = before.select("name", F.col("n").alias("before")).join(after.select("name", F.col("n").alias("after")), "name", "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def all_of(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def require_none(rules: DataFrame, show: int = 5) -> None:
    found = rules.limit(show).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']}" for r in found))
