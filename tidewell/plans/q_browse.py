"""Registered queries: turns and cards."""

from pyspark.sql import functions as F

from tidewell.functions.columns import card_text, clean_user_text, estimate_tokens
from tidewell.operators import browse, rounds
from tidewell.plans.registry import NOW, VIEWER, query

SEEN = f"(room = '{VIEWER}' OR regexp_matches(share, '\\S'))"


@query("SELECT session_id, source_uuid, round, message_seq FROM turns")
def assign_rounds(c):
    return c.turns.select("session_id", "source_uuid", "round", "message_seq")


@query("SELECT session_id, source_uuid, role, major, minor FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_uuid ORDER BY major, minor) AS k FROM candidates) WHERE k = 1")
def dedup_turns(c):
    return rounds.dedup_turns(c.candidates).select("session_id", "source_uuid", "role", "major", "minor")


@query("SELECT session_id, round, message_seq, role, text, ts FROM turns")
def session_replay(c):
    return rounds.session_replay(c.turns)


@query("SELECT session_id, count(*) AS n_turns, count(DISTINCT round) AS n_rounds, max(round) AS max_round, min(ts) AS first_at, max(ts) AS last_at FROM turns GROUP BY session_id")
def turn_stats(c):
    return rounds.turn_stats(c.turns)


@query(f"SELECT card_id, room, headline FROM cards WHERE {SEEN}")
def visible_cards(c):
    return browse.visible_cards(c.cards, VIEWER).select("card_id", "room", "headline")


@query(f"SELECT card_id, room, share, CASE WHEN room = '{VIEWER}' THEN private ELSE '' END AS private FROM cards WHERE {SEEN}")
def masked_view(c):
    return browse.masked_view(c.cards, VIEWER).select("card_id", "room", "share", "private")


@query(f"""SELECT c.card_id, c.headline, c.share, CASE WHEN room = '{VIEWER}' THEN private ELSE '' END AS private, coalesce(t.tags, '') AS tags
  FROM cards c LEFT JOIN (SELECT card_id, string_agg(DISTINCT tag, '/' ORDER BY tag) AS tags FROM card_tags GROUP BY card_id) t ON t.card_id = c.card_id WHERE {SEEN}""")
def card_detail(c):
    return browse.card_detail(c.cards, c.card_tags, VIEWER).select("card_id", "headline", "share", "private", "tags")


@query(f"SELECT card_id, room, headline, card_ts FROM cards WHERE {SEEN} AND card_ts >= TIMESTAMP '2024-01-01' AND card_ts < TIMESTAMP '2024-01-21' ORDER BY card_ts DESC, card_id LIMIT 20")
def recent(c):
    return browse.recent(c.cards, VIEWER, 20, since="2024-01-01", until_date="2024-01-20").select("card_id", "room", "headline", "card_ts")


SPAN = "SELECT c.card_id, t.* FROM cards c JOIN turns t ON t.session_id = c.session_id AND t.round BETWEEN c.turn_start AND c.turn_end"


@query(f"SELECT card_id, session_id, round, message_seq, role, text FROM ({SPAN} WHERE c.room = '{VIEWER}')")
def card_turns(c):
    return browse.card_turns(c.cards, c.turns, VIEWER).select("card_id", "session_id", "round", "message_seq", "role", "text")


@query(f"SELECT card_id, source_uuid, row_number() OVER (PARTITION BY card_id ORDER BY round, message_seq) AS position FROM ({SPAN})")
def card_nodes(c):
    from pyspark.sql.window import Window as W

    spans = browse.card_spans(c.cards, c.turns)
    return spans.select("card_id", "source_uuid", F.row_number().over(W.partitionBy("card_id").orderBy("round", "message_seq")).cast("long").alias("position"))


PLACED = f"""SELECT session_id, card_id, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(turn_start, 0), card_ts, card_id) - 1 AS idx,
  count(*) OVER (PARTITION BY session_id) AS n FROM cards WHERE {SEEN}"""


@query("SELECT a.card_id AS anchor, b.card_id, CAST(b.idx AS INTEGER) AS idx FROM placed a JOIN placed b ON a.session_id = b.session_id AND b.idx >= greatest(0, least(greatest(a.idx - 1, 0) + 3, a.n) - 3) AND b.idx < least(greatest(a.idx - 1, 0) + 3, a.n)", placed=PLACED)
def session_around(c):
    return browse.around(browse.ordered_siblings(c.cards, VIEWER), 3)


@query("SELECT a.card_id AS anchor, b.card_id, CAST(b.idx AS INTEGER) AS idx FROM placed a JOIN placed b ON a.session_id = b.session_id AND b.idx < a.idx AND b.idx >= a.idx - 2", placed=PLACED)
def session_before(c):
    return browse.before(browse.ordered_siblings(c.cards, VIEWER), 2)


@query(f"""SELECT c.card_id, coalesce(n, 0) AS n_access, md5(c.card_id) AS dice FROM cards c LEFT JOIN (SELECT card_id, count(*) AS n FROM access WHERE viewer = '{VIEWER}' GROUP BY card_id) a ON a.card_id = c.card_id
  WHERE {SEEN} AND card_ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY ORDER BY 2, 3 LIMIT 30""")
def wander_rank(c):
    return browse.wander_rank(c.cards, c.access, VIEWER, NOW).orderBy("n_access", "dice").limit(30)


@query(f"""SELECT card_id, round, message_seq, text, CAST(running AS BIGINT) AS running FROM (
  SELECT card_id, round, message_seq, substr(text, 1, 300) AS text, sum(least(length(text), 300)) OVER (PARTITION BY card_id ORDER BY round, message_seq) AS running FROM ({SPAN})) WHERE running <= 700""")
def clip_turns(c):
    spans = browse.card_spans(c.cards, c.turns).select("card_id", "round", "message_seq", "text")
    return browse.clip(spans, "text", ["card_id"], ["round", "message_seq"], 300, 700)


SIGNED = f"SELECT c.card_id, coalesce(s.signature, c.card_id) AS signature FROM cards c LEFT JOIN (SELECT card_id, md5(string_agg(source_uuid, '|' ORDER BY round, message_seq)) AS signature FROM ({SPAN}) GROUP BY card_id) s ON s.card_id = c.card_id"


@query("SELECT card_id, signature FROM (SELECT c.card_id, signature, row_number() OVER (PARTITION BY signature ORDER BY card_ts DESC, c.card_id) AS k FROM cards c JOIN signed s ON s.card_id = c.card_id) WHERE k = 1", signed=SIGNED)
def context_dedupe(c):
    return browse.context_dedupe(c.cards, c.turns).select("card_id", "signature")


@query(
    "SELECT card_id, room, headline, CAST(card_ts AS DATE) AS day FROM (SELECT n.*, row_number() OVER (PARTITION BY signature ORDER BY card_ts DESC, n.card_id) AS k FROM newest n JOIN signed s ON s.card_id = n.card_id) WHERE k = 1",
    signed=SIGNED,
    newest=f"SELECT * FROM cards WHERE {SEEN} AND card_ts BETWEEN TIMESTAMP '2024-01-02 12:00:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-01-02 12:00:00' ORDER BY card_ts DESC, card_id LIMIT 80",
)
def last24(c):
    return browse.last24(c.cards, c.turns, VIEWER, "2024-01-02 12:00:00").select("card_id", "room", "headline", "day")


@query(f"""SELECT c.card_id, coalesce(s.at, w.at) AS at FROM cards c LEFT JOIN (SELECT card_id, arg_max(ts, round * 100000 + message_seq) AS at FROM ({SPAN}) GROUP BY card_id) s ON s.card_id = c.card_id
  LEFT JOIN (SELECT session_id, max(ts) AS at FROM turns GROUP BY session_id) w ON w.session_id = c.session_id""")
def card_timestamp(c):
    return browse.card_timestamp(c.cards, c.turns)


@query("""SELECT c.card_id, c.session_id, c.headline, c.share, c.private, c.room, coalesce(t.tags, '') AS tags, coalesce(t.n, 0) AS n_tags
  FROM cards c LEFT JOIN (SELECT card_id, string_agg(tag, '/' ORDER BY tag) AS tags, count(*) AS n FROM card_tags GROUP BY card_id) t ON t.card_id = c.card_id""")
def card_export(c):
    tags = c.card_tags.groupBy("card_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), "/").alias("tags"), F.count("*").alias("n_tags"))
    rows = c.cards.select("card_id", "session_id", "headline", "share", "private", "room").join(tags, "card_id", "left")
    return rows.withColumn("tags", F.coalesce("tags", F.lit(""))).withColumn("n_tags", F.coalesce("n_tags", F.lit(0)).cast("long"))


@query(f"""SELECT (SELECT count(*) FROM cards WHERE card_ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}') AS cards_24h,
  (SELECT count(*) FROM turns WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}') AS turns_24h,
  (SELECT count(*) FROM cards) AS cards_all, (SELECT max(card_ts) FROM cards) AS newest_card""")
def health(c):
    moment = F.lit(NOW).cast("timestamp_ntz")
    day = lambda x: F.sum((F.col(x).between(moment - F.expr("INTERVAL 24 HOURS"), moment)).cast("long"))
    cards = c.cards.agg(day("card_ts").alias("cards_24h"), F.count("*").alias("cards_all"), F.max("card_ts").alias("newest_card"))
    return cards.crossJoin(c.turns.agg(F.coalesce(day("ts"), F.lit(0)).cast("long").alias("turns_24h")))


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(rf"""SELECT doc_id, CASE WHEN doc_id % 12 IN (0, 1, 11) THEN {STRIPPED} WHEN doc_id % 12 = 7 THEN CASE WHEN regexp_full_match({STRIPPED}, '[\p{{L}}\p{{M}}\p{{N}}_./:@-]*') THEN '' ELSE {STRIPPED} END
  WHEN doc_id % 12 = 8 THEN 'I typed <command-name> today: ' || regexp_replace(text, '\s+$', '') WHEN doc_id % 12 = 9 THEN '修好它。' ELSE '' END AS cleaned FROM documents""")
def clean_messages(c):
    """Whole documents as users' messages, plain and in each wrapper that a runtime puts around text."""
    text, d = F.col("text"), F.col("doc_id") % 12
    wrap = lambda before, after="": F.concat(F.lit(before), text, F.lit(after))
    raw = (
        F.when(d == 1, wrap("<system-reminder>a\nb</system-reminder>")).when(d == 2, wrap("<task-notification>")).when(d == 3, wrap('{"type":"result","x":1} '))
        .when(d == 4, F.lit(" [Request interrupted by user]\n")).when(d == 5, wrap("<local-command-stdout>")).when(d == 6, F.lit("<command-name>/model</command-name>\n<command-args>maker/x-4.1</command-args>"))
        .when(d == 7, wrap("<command-name>/goal</command-name>\n<command-args> ", "\n</command-args>")).when(d == 8, wrap("I typed <command-name> today: "))
        .when(d == 9, F.lit("<command-name>/x</command-name><command-args>修好它。</command-args>")).when(d == 10, wrap("[heartbeat] 12:00\n# atrun ")).when(d == 11, wrap("", "\n<system-reminder>x</system-reminder>\n")).otherwise(text)
    )
    return c.table("documents").select("doc_id", clean_user_text(raw).alias("cleaned"))


@query(r"""SELECT card_id, CASE WHEN regexp_matches(share, '\S') AND regexp_matches(private, '\S') THEN trim(headline) || chr(10) || trim(share) || chr(10) || trim(private)
  ELSE trim(headline) || chr(10) || trim(share || private) END AS card_text, CAST(ceil(length(share) / 4.0) AS BIGINT) AS share_tokens FROM cards""")
def card_texts(c):
    return c.cards.select("card_id", card_text(F.col("headline"), F.col("share"), F.col("private")).alias("card_text"), estimate_tokens(F.col("share")).cast("long").alias("share_tokens"))
