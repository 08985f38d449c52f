"""What the engine hands out: messages as JSON, a room's files, a bundle of what a viewer may see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.columns import visible
from tidewell.operators import browse, midlayer
from tidewell.store import Texts


def message_lines(turns: DataFrame, tail: int | None = None) -> DataFrame:
    """(session_id, line): turns as JSON objects, one a row; tail: only the last rounds of each session."""
    if tail is not None:
        last = turns.groupBy("session_id").agg(F.max("round").alias("_last"))
        turns = turns.join(last, "session_id").where(F.col("round") > F.col("_last") - tail).drop("_last")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return turns.select("session_id", "round", "message_seq", F.to_json(F.struct("session_id", "round", "message_seq", "source_uuid", "role", stamp.alias("timestamp"), "text")).alias("line"))


def dump_json(turns: DataFrame, path: str, tail: int | None = None) -> None:
    """JSON lines, each session's in order within its file."""
    lines = message_lines(turns, tail)
    lines.repartition("session_id").sortWithinPartitions("session_id", "round", "message_seq").select("line").write.mode("overwrite").text(path)


def constants_text(rows: list[dict], room: str) -> str:
    """A room's constants: what all rooms share, then its own; rows: content, shared, in order."""
    part = lambda shared: [f"- {r['content']}" for r in rows if bool(r["shared"]) is shared] or ["- (none)"]
    return "\n".join([f"# constants of {room}", "", "## shared", *part(True), "", f"## {room}", *part(False)]) + "\n"


def digest_text(night: str, body: str) -> str:
    return f"# digest of {night}\n\n{body.strip()}\n"


def publish(spark: SparkSession, path: str, room: str, files: dict[str, str]) -> None:
    """Puts a room's texts into its folder, each replaced by a rename; a blank text is refused and the file stays as it was."""
    if blank := sorted(n for n, text in files.items() if not text.strip()):
        raise ValueError(f"{blank[0]} is blank")
    folder = Texts(spark, f"{path}/{room}")
    for name, text in files.items():
        folder.put(name, text)


def room_plan(cards: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """(room, n_cards, action): `skip` where a room is switched off or has no cards, else `run`; a room that isn't named is on."""
    rooms = cards.groupBy("room").agg(F.count("*").alias("n_cards"))
    on = F.create_map(*[F.lit(x) for pair in enabled.items() for x in pair]) if enabled else F.create_map(F.lit(""), F.lit(True))
    return rooms.select("room", "n_cards", F.when(F.coalesce(F.try_element_at(on, F.col("room")), F.lit(True)) & (F.col("n_cards") > 0), "run").otherwise("skip").alias("action"))


def bundle(cards: DataFrame, card_tags: DataFrame, clusters: DataFrame, members: DataFrame, closure: DataFrame, constants: DataFrame, turns: DataFrame, viewer: str) -> dict[str, DataFrame]:
    """The seven tables that a viewer may take along: cards (masked), tags, turns of own cards, members, clusters that hold one of the cards, their summaries, constants."""
    seen = browse.masked_view(cards, viewer)
    ids = seen.select("card_id")
    own = cards.where(visible(viewer) & (F.col("room") == viewer))
    held = members.join(ids, "card_id", "left_semi")
    kept = closure.join(held.select(F.col("cluster_id").alias("member")).distinct(), "member", "left_semi").select("cluster_id").distinct()
    return {
        "cards": seen, "card_tags": card_tags.join(ids, "card_id", "left_semi"), "turns": browse.card_turns(own, turns, viewer), "members": held, "clusters": clusters.join(kept, "cluster_id", "left_semi"),
        "summaries": midlayer.communities(closure, held, seen), "constants": midlayer.active_constants(constants, viewer),
    }


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
