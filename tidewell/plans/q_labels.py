"""Registered queries: labels, keys, snippets, times."""

from pyspark.sql import functions as F

from tidewell.functions import columns as k
from tidewell.functions import labels
from tidewell.operators import index, search
from tidewell.plans.registry import query


@query("SELECT card_id, sha1('api|m1|' || share) AS cache_key FROM cards")
def embedding_cache_key(c):
    return c.cards.select("card_id", labels.cache_key("api", "m1", F.col("share")).alias("cache_key"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'plain' || doc_id WHEN doc_id % 4 = 1 THEN 'The Known' ELSE 'fam' || lang || ' ' || (doc_id % 5) || '.' || (doc_id % 3) END AS label FROM documents")
def source_labels(c):
    d = F.col("doc_id")
    model = F.when(d % 4 == 0, F.concat(F.lit("plain"), d.cast("string"))).when(d % 4 == 1, F.lit("known-x")).otherwise(F.concat(F.lit("fam"), "lang", F.lit("-"), (d % 5).cast("string"), F.lit("-"), (d % 3).cast("string"), F.lit("-20240101")))
    return c.table("documents").select("doc_id", labels.source_label(model, {"known-x": "The Known"}).alias("label"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'one' WHEN source LIKE 'src1%' THEN 'teens' WHEN source = 'src7' THEN 'seven' END AS room, source LIKE 'src_' AS short FROM documents")
def path_rooms(c):
    path = F.concat(F.lit("/logs/"), "source", F.lit("/x.jsonl"))
    rules = {"/logs/src1": "teens", "/logs/src1/": "one", "/logs/src7/": "seven"}
    return c.table("documents").select("doc_id", labels.room_of_path(path, rules).alias("room"), labels.matches_glob(path, ["/logs/src[0-9]/*"]).alias("short"))


@query(
    r"""SELECT card_id, CASE WHEN s > 0 THEN '…' ELSE '' END || substr(flat, s + 1, 140) || CASE WHEN s + 140 < length(flat) THEN '…' ELSE '' END AS snippet FROM (
      SELECT card_id, flat, greatest(CASE WHEN strpos(lower(flat), 'thing') > 0 THEN strpos(lower(flat), 'thing') ELSE 1 END - 1 - 46, 0) AS s FROM (SELECT card_id, trim(regexp_replace(share, '\s+', ' ', 'g')) AS flat FROM cards))"""
)
def card_snippets(c):
    return c.cards.select("card_id", search.snippet(F.col("share"), ["thing"]).alias("snippet"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day FROM events")
def local_times(c):
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("ts").cast("timestamp_ntz"))
    return c.table("events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local"), F.to_date(local).alias("day"))


@query("SELECT session_id, round, message_seq, lpad(CAST(round AS VARCHAR), 2, '0') || CASE WHEN role = 'user' THEN 'L' ELSE 'C' END AS label FROM turns")
def turn_labels(c):
    return c.turns.select("session_id", "round", "message_seq", k.round_label(F.col("round"), F.col("role")).alias("label"))


@query("SELECT tag, entity, CAST(row_number() OVER (ORDER BY entity) + 100 AS BIGINT) AS entity_id FROM (SELECT min(tag) AS tag, entity FROM tag_map GROUP BY entity HAVING count(*) = 1)")
def new_entities(c):
    """Entities of a single tag get ids after those that are there (100)."""
    single = c.tag_map.groupBy("entity").agg(F.min("tag").alias("tag"), F.count("*").alias("n")).where("n = 1")
    return index.numbered(single.select("tag", "entity"), "entity", "entity_id", 101)


@query(
    """SELECT (SELECT count(*) FROM entities_q) AS n_pairs, (SELECT count(DISTINCT card_id) FROM entities_q) AS n_cards, (SELECT count(*) FROM cards WHERE card_id NOT IN (SELECT card_id FROM card_tags)) AS n_untagged""",
    entities_q="SELECT DISTINCT card_id, entity FROM card_tags JOIN tag_map USING (tag)",
)
def protected_state(c):
    """Counts that a maintenance run must leave as they are."""
    pairs = index.card_entities(c.card_tags, c.tag_map).agg(F.count("*").alias("n_pairs"), F.countDistinct("card_id").alias("n_cards"))
    return pairs.crossJoin(c.cards.join(c.card_tags, "card_id", "left_anti").agg(F.count("*").alias("n_untagged")))
