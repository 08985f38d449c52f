"""Versions of the stored tables' schema, steps from one to the next, and repairs that are asked for by name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import journal
from tidewell.store import Texts, VersionedTable

VERSION = 3
Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
STEPS: dict[int, Step] = {}


def step(to: int) -> Callable[[Step], Step]:
    """Registers the step that brings the tables to a version."""

    def register(fn: Step) -> Step:
        STEPS[to] = fn
        return fn

    return register


@step(2)
def headline_from_share(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cards had no headline: it is the first line of the share, or else of the private text."""
    first = lambda c: F.split_part(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(1))
    made = F.when(first("share") != "", first("share")).otherwise(first("private"))
    return tables | {"cards": tables["cards"].withColumn("headline", made)} if "headline" not in tables["cards"].columns else tables


@step(3)
def seconds_to_times(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Times of turns were text; a text that is no time becomes null."""
    turns = tables["turns"]
    return tables | {"turns": turns.withColumn("ts", F.try_to_timestamp("ts").cast("timestamp_ntz"))} if dict(turns.dtypes)["ts"] == "string" else tables


def stored_version(spark: SparkSession, path: str) -> int:
    found = Texts(spark, path).get("_SCHEMA")
    return json.loads(found)["version"] if found else 1


def require_version(spark: SparkSession, path: str, version: int = VERSION) -> None:
    """A reader takes tables of its own version only."""
    if (found := stored_version(spark, path)) != version:
        raise ValueError(f"the tables have version {found}, this engine reads {version}")


def migrate(spark: SparkSession, path: str, names: list[str], to: int = VERSION) -> int:
    """Applies the missing steps to the versioned tables and then notes the version; a crash before that repeats steps, which change nothing twice."""
    at = stored_version(spark, path)
    if at > to:
        raise ValueError(f"version {at} is newer than {to}")
    stores = {n: VersionedTable(spark, f"{path}/{n}") for n in names}
    tables = {n: rows for n, s in stores.items() if (rows := s.read()) is not None}
    for version in range(at + 1, to + 1):
        if version not in STEPS:
            raise ValueError(f"no step to version {version}")
        tables = STEPS[version](tables)
    if at < to:
        staged = {n: stores[n].stage(rows) for n, rows in tables.items()}
        for n, version in staged.items():
            stores[n].swap(version)
        Texts(spark, path).put("_SCHEMA", json.dumps({"version": to}))
    return to - at


def attempt_impact(failed: DataFrame, turns: DataFrame, cards: DataFrame) -> DataFrame:
    """(source_uuid, session_id, round, n_cards): stored turns that were failed attempts, and how many cards cover their round.

    failed: user_uuid.  turns: session_id, source_uuid, round.  cards: session_id, turn_start, turn_end.
    """
    hit = turns.join(failed.select(F.col("user_uuid").alias("source_uuid")).distinct(), "source_uuid").select("session_id", "source_uuid", "round")
    spans = cards.select("session_id", "card_id", F.explode(F.sequence(F.col("turn_start").cast("long"), F.greatest("turn_start", "turn_end").cast("long"))).alias("round"))
    return hit.join(spans, ["session_id", "round"], "left").groupBy("source_uuid", "session_id", "round").agg(F.count("card_id").alias("n_cards"))


def repair_attempts(failed: DataFrame, turns: DataFrame, cards: DataFrame, apply: bool = False) -> DataFrame:
    """turns without failed attempts; refused where a card covers one, as its text was made from it.  Without apply the turns as they are."""
    impact = attempt_impact(failed, turns, cards)
    if covered := impact.where("n_cards > 0").limit(1).collect():
        raise ValueError(f"a card covers {covered[0]['source_uuid']}")
    return turns.join(impact.select("source_uuid"), "source_uuid", "left_anti") if apply else turns


def failed_of(parsed: DataFrame) -> DataFrame:
    return journal.failed_attempts(parsed.where("NOT bad"))
