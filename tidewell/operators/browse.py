"""Reading cards: visibility, masking, ranges, windows around a card, least-read cards, context ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import masked_private, visible


def visible_cards(cards: DataFrame, viewer: str | None) -> DataFrame:
    return cards.where(visible(viewer))


def masked_view(cards: DataFrame, viewer: str | None) -> DataFrame:
    """Visible cards; private text only of the viewer's own room."""
    return visible_cards(cards, viewer).withColumn("private", masked_private(viewer))


def tags_of(card_tags: DataFrame) -> DataFrame:
    return card_tags.groupBy("card_id").agg(F.array_join(F.sort_array(F.collect_set("tag")), "/").alias("tags"))


def card_detail(cards: DataFrame, card_tags: DataFrame, viewer: str | None, ids: DataFrame | None = None) -> DataFrame:
    """Masked cards with their tags; ids: a table of card_id to look up."""
    rows = masked_view(cards, viewer)
    if ids is not None:  # a look-up: both sides are cut down before tags are grouped
        wanted = F.broadcast(ids.select("card_id")) if ids.limit(10_001).count() <= 10_000 else ids.select("card_id")
        rows, card_tags = rows.join(wanted, "card_id", "left_semi"), card_tags.join(wanted, "card_id", "left_semi")
    return rows.join(tags_of(card_tags), "card_id", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def time_range(cards: DataFrame, since: str | None = None, until_date: str | None = None) -> DataFrame:
    """From since on, up to the end of the day until_date."""
    if since is not None:
        cards = cards.where(F.col("card_ts") >= F.lit(since).cast("timestamp_ntz"))
    if until_date is not None:
        cards = cards.where(F.col("card_ts") < F.date_add(F.lit(until_date).cast("date"), 1).cast("timestamp_ntz"))
    return cards


def recent(cards: DataFrame, viewer: str | None, limit: int | None = 20, **between: str) -> DataFrame:
    """Newest first, ties by id; limit None or 0 gives all."""
    rows = time_range(visible_cards(cards, viewer), **between).orderBy(F.desc("card_ts"), "card_id")
    return rows.limit(limit) if limit else rows


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100) -> tuple[DataFrame, bool]:
    """(rows of the page, are there more); one row more than asked for tells."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit is 1 to {most}, offset not negative")
    cut = rows.orderBy(*order).offset(offset).limit(limit + 1)
    return cut.limit(limit), cut.count() > limit


def card_spans(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """card_id with each turn of its span: the rounds turn_start to turn_end of its session, both included.

    A span becomes one row a round, so the join is an equi-join on (session, round) and needs no range comparison.
    Null bounds are open: the whole session from its first, or to its last round.
    """
    last = turns.groupBy("session_id").agg(F.max("round").alias("_last"))
    spans = cards.join(last, "session_id").select("card_id", "session_id", F.coalesce("turn_start", F.lit(1)).cast("long").alias("a"), F.least(F.coalesce(F.col("turn_end"), F.col("_last")), F.col("_last")).cast("long").alias("b"))
    rounds = spans.where("a <= b").select("card_id", "session_id", F.explode(F.sequence("a", "b")).alias("round"))
    return rounds.join(turns, ["session_id", "round"])


def card_turns(cards: DataFrame, turns: DataFrame, viewer: str | None) -> DataFrame:
    """Raw turns are for the owner alone."""
    own = cards if viewer is None else cards.where(F.col("room") == viewer)
    return card_spans(own, turns)


def ordered_siblings(cards: DataFrame, viewer: str | None) -> DataFrame:
    """Visible cards with their place idx in the session's story, and the session's number of cards n."""
    w = W.partitionBy("session_id")
    order = w.orderBy(F.coalesce("turn_start", F.lit(0)), "card_ts", "card_id")
    rows = visible_cards(cards, viewer).select("session_id", "card_id", "turn_start", "card_ts")
    return rows.withColumn("idx", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(w).cast("int")).drop("turn_start", "card_ts")


def around(siblings: DataFrame, limit: int) -> DataFrame:
    """(anchor, card_id, idx) of up to limit cards around each anchor, itself included; windows at an end are filled from the other side."""
    if limit < 1:
        raise ValueError("limit is 1 at least")
    begin = F.greatest(F.col("idx") - limit // 2, F.lit(0))
    end = F.least(begin + limit, F.col("n"))
    wanted = siblings.select("session_id", F.col("card_id").alias("anchor"), F.explode(F.sequence(F.greatest(end - limit, F.lit(0)), end - 1)).alias("idx"))
    return wanted.join(siblings.select("session_id", "card_id", "idx"), ["session_id", "idx"]).select("anchor", "card_id", "idx")


def before(siblings: DataFrame, limit: int) -> DataFrame:
    """(anchor, card_id, idx) of the nearest limit cards in front of each anchor, in story order."""
    if limit < 1:
        raise ValueError("limit is 1 at least")
    wanted = siblings.where("idx > 0").select("session_id", F.col("card_id").alias("anchor"), F.explode(F.sequence(F.greatest(F.col("idx") - limit, F.lit(0)), F.col("idx") - 1)).alias("idx"))
    return wanted.join(siblings.select("session_id", "card_id", "idx"), ["session_id", "idx"]).select("anchor", "card_id", "idx")


def wander_rank(cards: DataFrame, access: DataFrame, viewer: str | None, now: str, days: int = 7, seed: int | None = None) -> DataFrame:
    """Visible cards older than so many days with the viewer's reads; least read first, then by dice: a hash of the id and the seed.

    Another seed is another draw; the same one repeats it, whatever the partitions.
    """
    reads = (access if viewer is None else access.where(F.col("viewer") == viewer)).groupBy("card_id").agg(F.count("*").alias("n_access"))
    old = visible_cards(cards, viewer).where(F.col("card_ts") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return old.join(reads, "card_id", "left").select("card_id", F.coalesce("n_access", F.lit(0)).cast("long").alias("n_access"), F.md5((F.col("card_id") if seed is None else F.concat(F.lit(f"{seed}|"), "card_id")).cast("binary")).alias("dice"))


def clip(rows: DataFrame, text: str, partition: list[str], order: list[str], field_chars: int, total_chars: int) -> DataFrame:
    """text cut to field_chars; rows of a partition end where the running total passes total_chars."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = rows.withColumn(text, F.substring(text, 1, field_chars))
    return cut.withColumn("running", F.sum(F.length(text)).over(w)).where(F.col("running") <= total_chars)


def span_signature(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """(card_id, signature): the ordered source ids of its span, or the card's own id without turns."""
    spans = card_spans(cards, turns).groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("round", "message_seq", "source_uuid"))).alias("s"))
    joined = cards.select("card_id").join(spans, "card_id", "left")
    return joined.select("card_id", F.coalesce(F.md5(F.array_join(F.transform("s", lambda x: x["source_uuid"]), "|").cast("binary")), F.col("card_id")).alias("signature"))


def context_dedupe(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """Of cards with one signature the newest stays."""
    signed = cards.join(span_signature(cards, turns), "card_id")
    w = W.partitionBy("signature").orderBy(F.desc("card_ts"), "card_id")
    return signed.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def last24(cards: DataFrame, turns: DataFrame, viewer: str | None, now: str, limit: int = 80) -> DataFrame:
    """The ledger of the day before now: the newest limit visible cards, then one for each signature, with local day."""
    moment = F.lit(now).cast("timestamp_ntz")
    window = visible_cards(cards, viewer).where((F.col("card_ts") >= moment - F.expr("INTERVAL 24 HOURS")) & (F.col("card_ts") <= moment))
    newest = window.orderBy(F.desc("card_ts"), "card_id").limit(limit)
    return context_dedupe(newest, turns).withColumn("day", F.to_date("card_ts"))


def card_timestamp(cards: DataFrame, turns: DataFrame) -> DataFrame:
    """(card_id, at): the time of the last turn in a card's span, or else of its session."""
    inside = card_spans(cards, turns).groupBy("card_id").agg(F.max_by("ts", F.struct("round", "message_seq")).alias("span_at"))
    whole = turns.groupBy("session_id").agg(F.max("ts").alias("session_at"))
    joined = cards.select("card_id", "session_id").join(inside, "card_id", "left").join(whole, "session_id", "left")
    return joined.select("card_id", F.coalesce("span_at", "session_at").alias("at"))


def session_cards(cards: DataFrame, session_id: int | None = None) -> DataFrame:
    """(session_id, card_id, k): each session's cards by first round, time and id."""
    rows = cards if session_id is None else cards.where(F.col("session_id") == session_id)
    order = W.partitionBy("session_id").orderBy(F.coalesce("turn_start", F.lit(0)), "card_ts", "card_id")
    return rows.select("session_id", "card_id", F.row_number().over(order).alias("k"))


def headlines(ids: DataFrame, cards: DataFrame, limit: int) -> DataFrame:
    """(group, pos, headline) of the first `limit` ids (group, card_id, pos) that are cards, in the order of pos."""
    found = ids.join(cards.select("card_id", "headline"), "card_id")
    rank = F.row_number().over(W.partitionBy("group").orderBy("pos", "card_id"))
    return found.withColumn("_k", rank).where(F.col("_k") <= limit).select("group", "pos", "headline")


def file_sessions(candidates: DataFrame) -> DataFrame:
    """(file, session) pairs of candidates (file, session_id): what `touched_files` expands over."""
    return candidates.select("file", F.col("session_id").alias("session")).distinct()
