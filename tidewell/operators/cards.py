"""Cards from text: parser, plan of a tail's rewrite, gate, freeze and refeed, summariser protocol."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidewell.functions.columns import strip


def parse_cards(text: Column) -> Column:
    """array<struct<turn_start, turn_end, headline, share, private, tags>> from blocks of `turns:a-b`, `headline:`, `share:`, `private:`, `tags:`.

    A field goes on until the next one; an empty field stays empty; a block without turns is no card.
    """
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^turns:\s*\d+\s*-\s*\d+.*?(?=^turns:|\z)"), F.lit(0))
    part = lambda b, name: strip(F.regexp_extract(b, rf"(?ms)^{name}:[ \t]*(.*?)\s*(?=^(?:headline|share|private|tags|turns):|\z)", 1))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, r"turns:\s*(\d+)", 1).cast("int").alias("turn_start"), F.regexp_extract(b, r"turns:\s*\d+\s*-\s*(\d+)", 1).cast("int").alias("turn_end"),
            part(b, "headline").alias("headline"), part(b, "share").alias("share"), part(b, "private").alias("private"),
            F.array_distinct(F.filter(F.transform(F.split(part(b, "tags"), r"[/、,，\s]+"), lambda t: F.lower(F.trim(t))), lambda t: t != "")).alias("tags"),
        ),
    )


def card_gate(turns: DataFrame, calls: DataFrame, now: str, min_rounds: int = 5, min_minutes: int = 60) -> DataFrame:
    """(session_id, new_rounds, open): rounds since the last success reach min_rounds, and the last attempt is min_minutes ago.

    turns: session_id, round, ts.  calls: session_id, called_at, ok.
    """
    last = calls.groupBy("session_id").agg(F.max("called_at").alias("attempt"), F.max(F.when(F.col("ok"), F.col("called_at"))).alias("success"))
    joined = turns.join(last, "session_id", "left")
    new = joined.where(F.col("success").isNull() | (F.col("ts") > F.col("success"))).groupBy("session_id").agg(F.countDistinct("round").alias("new_rounds"))
    rows = turns.select("session_id").distinct().join(new, "session_id", "left").join(last, "session_id", "left").withColumn("new_rounds", F.coalesce("new_rounds", F.lit(0)).cast("long"))
    rested = F.col("attempt").isNull() | (F.col("attempt") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(min_minutes)} MINUTES"))
    return rows.select("session_id", "new_rounds", ((F.col("new_rounds") >= min_rounds) & rested).alias("open"))


def gate_by_source(turns: DataFrame, calls: DataFrame, now: str, limits: dict[str, tuple[int, int]], default: tuple[int, int] = (5, 60)) -> DataFrame:
    """(session_id, source, new_rounds, open): the gate with the least rounds and minutes of each session's source; turns: session_id, round, ts, source."""
    of = turns.groupBy("session_id").agg(F.min("source").alias("source"))
    pick = lambda i: F.coalesce(*[F.when(F.col("source") == s, F.lit(v[i])) for s, v in sorted(limits.items())], F.lit(default[i]))
    last = calls.groupBy("session_id").agg(F.max("called_at").alias("attempt"))
    rows = card_gate(turns, calls, now, 0, 0).drop("open").join(of, "session_id").join(last, "session_id", "left")
    waited = F.timestamp_diff("SECOND", F.col("attempt"), F.lit(now).cast("timestamp_ntz")) >= 60 * pick(1)
    return rows.select("session_id", "source", "new_rounds", ((F.col("new_rounds") >= pick(0)) & (F.col("attempt").isNull() | waited)).alias("open"))


def tail_plan(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, prefix_cards, start_round, max_round, owned): what a rewrite of each session's tail replaces.

    All cards but the last stay; the rewrite begins at the end of the last that stays, that round included, or at the session's
    first round; `owned` is the card that is replaced.
    """
    w = W.partitionBy("session_id").orderBy(F.desc("turn_end"), F.desc("turn_start"), F.desc("card_id"))
    ranked = cards.withColumn("k", F.row_number().over(w))
    per = ranked.groupBy("session_id").agg((F.count("*") - 1).alias("prefix_cards"), F.max(F.when(F.col("k") == 2, F.col("turn_end"))).alias("kept_end"), F.max(F.when(F.col("k") == 1, F.col("card_id"))).alias("owned"))
    stats = turns.groupBy("session_id").agg(F.min("round").alias("first_round"), F.max("round").alias("max_round"))
    rows = stats.join(per, "session_id", "left")
    return rows.select("session_id", F.coalesce("prefix_cards", F.lit(0)).cast("long").alias("prefix_cards"), F.coalesce("kept_end", "first_round").cast("long").alias("start_round"), "max_round", "owned")


def render_windows(turns: DataFrame, windows: DataFrame, names: dict[str, str], cap: int = 1600) -> DataFrame:
    """(session_id, lo, text): the rounds lo to hi of each window (session_id, lo, hi) as text: a head a round, a line a turn, cut at cap characters.

    names: what user and assistant are called.
    """
    wanted = windows.select("session_id", "lo", F.explode(F.sequence("lo", "hi")).alias("round"))
    said = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    shown = F.when(F.length(said) > cap, F.concat(F.substring(said, 1, cap), F.lit(" …"))).otherwise(said)
    who = F.when(F.col("role") == "user", names["user"]).otherwise(names["assistant"])
    head = F.when(F.col("message_seq") == 1, F.concat(F.lit("\nR"), F.col("round").cast("string"), F.lit("\n"))).otherwise("")
    lines = wanted.join(turns, ["session_id", "round"]).select("session_id", "lo", "round", "message_seq", F.concat(head, who, F.lit(": "), shown).alias("line"))
    grouped = lines.groupBy("session_id", "lo").agg(F.sort_array(F.collect_list(F.struct("round", "message_seq", "line"))).alias("lines"))
    return grouped.select("session_id", "lo", F.ltrim(F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"^\n", "")).alias("text"))


def covered(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, covered_round, max_round, done): done where a session's own last card ends at its last round or beyond, so that an update is no work."""
    last = cards.groupBy("session_id").agg(F.max("turn_end").cast("long").alias("covered_round"))
    most = turns.groupBy("session_id").agg(F.max("round").alias("max_round"))
    return most.join(last, "session_id", "left").select("session_id", "covered_round", "max_round", F.coalesce(F.col("covered_round") >= F.col("max_round"), F.lit(False)).alias("done"))


def run_sessions(sessions: list, work, most: int | None = None) -> tuple[list, dict]:
    """(done, failed): work on up to `most` sessions in order; one that fails doesn't stop the others, and its error is kept by its id.

    A caller that must not go on unheard raises on `failed`.
    """
    done, failed = [], {}
    for session in sessions[:most]:
        try:
            work(session)
            done.append(session)
        except Exception as problem:  # the isolation of sessions is the point
            failed[session] = f"{type(problem).__name__}: {problem}"
    return done, failed


def eligible_sessions(linear: DataFrame, branches: DataFrame) -> DataFrame:
    """(key, kind, last_at, k): sessions and tree branches with something new, the most active last first; each: key, last_at.  A key in both is a branch."""
    rows = branches.select("key", F.lit("branch").alias("kind"), "last_at").unionByName(linear.join(branches.select("key"), "key", "left_anti").select("key", F.lit("session").alias("kind"), "last_at"))
    return rows.withColumn("k", F.row_number().over(W.orderBy(F.desc("last_at"), "key")))  # a row a session to work on


def project_messages(nodes: DataFrame, stored: DataFrame, speakers: dict[str, str]) -> DataFrame:
    """Messages (source_uuid, role, speaker, text, ts) that nodes add to the stored ones; a node that differs from its stored message stops the load."""
    made = nodes.select(F.col("node_id").alias("source_uuid"), "role", F.when(F.col("role") == "user", speakers["user"]).otherwise(speakers["assistant"]).alias("speaker"), "text", F.col("occurred_at").alias("ts"))
    old = stored.select("source_uuid", F.struct("role", "text", "ts").alias("_old"))
    joined = made.join(old, "source_uuid", "left")
    differs = F.col("_old").isNotNull() & ~F.struct("role", "text", "ts").eqNullSafe(F.col("_old"))
    checked = joined.withColumn("role", F.when(differs, F.raise_error(F.concat(F.lit("projection conflict: "), "source_uuid"))).otherwise(F.col("role")))
    return checked.where(F.col("_old").isNull() | differs).drop("_old")


def upsert_sessions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Provenance by session: new rows (session_id, native_id, parent, route, room, seq) replace route, room and parent of a stored one, the last by seq; a
    session keeps its native id."""
    last = new.groupBy("session_id").agg(F.max_by(F.struct("native_id", "parent", "route", "room"), "seq").alias("n"))
    both = stored.withColumn("_s", F.lit(True)).join(last, "session_id", "full")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("session_id", F.coalesce("native_id", "n.native_id").alias("native_id"), pick("parent"), pick("route"), pick("room"))


def apply_decisions(cards: DataFrame, keep: DataFrame, drop: DataFrame, apply: bool = False) -> DataFrame:
    """cards without those to drop (card_id); an id that isn't there, or that is kept as well, stops it; without apply nothing is dropped."""
    unknown = drop.select("card_id").unionByName(keep.select("card_id")).distinct().join(cards.select("card_id"), "card_id", "left_anti").limit(1).collect()
    both = drop.join(keep, "card_id", "left_semi").limit(1).collect()
    if unknown or both:
        raise ValueError(f"{unknown[0]['card_id']} isn't there" if unknown else f"{both[0]['card_id']} is kept and dropped")
    return cards.join(drop.select("card_id"), "card_id", "left_anti") if apply else cards


def effective_cards(cards: DataFrame, forks: DataFrame) -> DataFrame:
    """(session_id, card_id, inherited): a session's own cards, and the parent's cards that end at or before the fork."""
    own = cards.select("session_id", "card_id", F.lit(False).alias("inherited"))
    parent = forks.select(F.col("child").alias("session_id"), "parent", "parent_round")
    taken = parent.join(cards.select(F.col("session_id").alias("parent"), "card_id", "turn_end"), "parent").where("turn_end <= parent_round")
    return own.unionByName(taken.select("session_id", "card_id", F.lit(True).alias("inherited")))


def reroom(cards: DataFrame, rooms: DataFrame) -> DataFrame:
    """cards with the room of their session's provenance (session_id, room) where that is known."""
    return cards.join(rooms.select("session_id", F.col("room").alias("_room")), "session_id", "left").withColumn("room", F.coalesce("_room", "room")).drop("_room")


def room_vote(turns: DataFrame) -> DataFrame:
    """(session_id, room): the room that most of a session's turns come from, of equals the greater name; turns: session_id, room (null: unknown)."""
    tally = turns.where("room IS NOT NULL").groupBy("session_id", "room").agg(F.count("*").alias("n"))
    return tally.groupBy("session_id").agg(F.max_by("room", F.struct("n", "room")).alias("room"))


def session_room(tree: DataFrame, envelope: DataFrame, votes: DataFrame) -> DataFrame:
    """(session_id, room, origin): the tree's room, else the envelope's, else the vote's; each: session_id, room."""
    parts = [t.select("session_id", F.struct(F.lit(i).alias("p"), F.lit(n).alias("origin"), "room").alias("r")) for i, (n, t) in enumerate((("tree", tree), ("envelope", envelope), ("vote", votes)))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("r.room IS NOT NULL")
    return rows.groupBy("session_id").agg(F.min("r").alias("r")).select("session_id", "r.room", "r.origin")


class Summarizer(Protocol):
    """Turns the rounds of a window into cards; anything that raises leaves the state as it was."""

    def __call__(self, rounds: list[int], texts: list[str]) -> list[tuple[int, int, str]]: ...


def extractive(rounds: list[int], texts: list[str], per_card: int = 4) -> list[tuple[int, int, str]]:
    """A deterministic stand-in: a card for each per_card rounds, headed by the first line of its first text."""
    out = []
    for i in range(0, len(rounds), per_card):
        part = rounds[i : i + per_card]
        out.append((part[0], part[-1], texts[i].strip().split("\n")[0][:80]))
    return out


def freeze_refeed(rounds: list[int], texts: list[str], summarize: Summarizer = extractive, init: int = 14, grow: int = 14) -> list[tuple[int, int, str]]:
    """The cards of a session's rounds, as `refeed` gives them one by one."""
    return list(refeed(zip(rounds, texts, strict=True), summarize, init, grow))


def refeed(rounds: Iterable[tuple[int, str]], summarize: Summarizer = extractive, init: int = 14, grow: int = 14) -> Iterator[tuple[int, int, str]]:
    """Cards of a session from its rounds in order: windows grow by `grow` rounds; with two cards or more all but the last are frozen, and the
    next window begins at the end round of the last frozen one, that round included.  No card at all is an error.  Only a window is held."""
    coming = iter(rounds)
    ahead, held, seen, end = next(coming, None), [], 0, init
    while True:
        while ahead is not None and seen < end:
            held.append(ahead)
            seen += 1
            ahead = next(coming, None)
        cards = _cards(summarize, [r for r, _ in held], [t for _, t in held])
        if ahead is None:
            yield from cards
            return
        if len(cards) >= 2:
            yield from cards[:-1]
            held = [x for x in held if x[0] >= cards[-2][1]]
        end += grow


def _cards(summarize: Summarizer, rounds: list[int], texts: list[str]) -> list[tuple[int, int, str]]:
    cards = summarize(rounds, texts)
    if not cards:
        raise ValueError("no card was parsed")
    return cards


def generate(turns: DataFrame, init: int = 14, grow: int = 14, summarize: Summarizer = extractive) -> DataFrame:
    """(session_id, n, turn_start, turn_end, headline): refeed over every session, on the whole text of all messages of each round.

    Sessions are sorted within partitions and stream through, so a task holds a window of rounds, however long its sessions are.
    """
    ordered = turns.select("session_id", "round", "message_seq", "text").repartition("session_id").sortWithinPartitions("session_id", "round", "message_seq")
    kind = turns.schema["session_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((session, number, text or "") for batch in batches for session, number, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True))
        out: list[tuple] = []
        for session, mine in groupby(rows, lambda r: r[0]):
            rounds = ((number, "\n".join(t for _, _, t in said)) for number, said in groupby(mine, lambda r: r[1]))
            out += [(session, i, *card) for i, card in enumerate(refeed(rounds, summarize, init, grow), 1)]
            if len(out) > 10_000:
                yield _card_rows(out)
                out = []
        if out:
            yield _card_rows(out)

    numbers = [T.StructField(n, T.LongType()) for n in ("n", "turn_start", "turn_end")]
    return ordered.mapInArrow(run, T.StructType([T.StructField("session_id", kind), *numbers, T.StructField("headline", T.StringType())]))


def _card_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["session_id", "n", "turn_start", "turn_end", "headline"])
