"""Registered queries: mixed loads, reconciliation, provenance, caches, repairs, windows and texts."""

from pyspark.sql import functions as F

from tidewell import models, publish, schema
from tidewell.functions import columns as k
from tidewell.operators import browse, components, index, tree, violations
from tidewell.operators import cards as cd
from tidewell.operators import search as se
from tidewell.plans.q_browse import SEEN, SPAN
from tidewell.plans.q_index import PAIRS
from tidewell.plans.q_mid import CLOSURE, CONSTANTS, constants
from tidewell.plans.registry import VIEWER, query
from tidewell.sources import mixed
from tidewell.streaming import ingest

S = lambda x: F.col(x).cast("string")
#: A conversation's file is of the family conv_id % 5: journal, strict envelope, export, transcript, plain array.
FAMILY = {
    "own_t": r"SELECT conv_id, turn, role, text, conv_id % 5 AS f, lpad(CAST(least(turn + 1, 99) AS VARCHAR), 2, '0') AS head FROM conversations WHERE role IN ('user', 'assistant') AND turn < 90 AND regexp_matches(text, '\S')",
    "cand_t": r"""SELECT CASE f WHEN 0 THEN 'session:' || substr(sha256('journal|s' || conv_id), 1, 32) WHEN 1 THEN 'session:' || substr(sha256('chat|s' || conv_id), 1, 32) WHEN 2 THEN 'session:' || substr(sha256('export|c' || conv_id), 1, 32)
      WHEN 3 THEN 'session:' || substr(sha256('transcript|/in/' || conv_id || '.txt'), 1, 32) ELSE 'session:' || substr(sha256('legacy|p' || conv_id), 1, 32) END AS session_id, conv_id, turn, role, f,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ord FROM own_t""",
    "num_t": "SELECT *, sum(CASE WHEN role = 'user' OR ord = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord) AS rnd FROM cand_t",
}


def files(c):
    """A file for each conversation, of the family that its id gives."""
    conv = c.table("conversations").where("role IN ('user', 'assistant') AND turn < 90").where(F.col("text").rlike(r"\S"))
    n, t = S("conv_id"), S("turn")
    uid, stamp = F.concat(F.lit("m"), n, F.lit("-"), t), F.lit("2024-01-01T00:00:00Z")
    of = lambda f, item: conv.where(F.col("conv_id") % 5 == f).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"]).alias("items"))
    name = lambda end: F.concat(F.lit("/in/"), S("conv_id"), F.lit(end)).alias("path")
    line = F.to_json(F.struct(uid.alias("uuid"), F.concat(F.lit("s"), n).alias("sessionId"), stamp.alias("timestamp"), F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    journal = of(0, line).select(name(".jsonl"), F.array_join("items", "\n").alias("value"))
    strict = F.struct(F.concat(F.lit("s"), n).alias("native_session_id"), uid.alias("native_message_id"), "role", "text", stamp.alias("occurred_at"), F.col("turn").cast("long").alias("source_sequence"))
    envelope = of(1, strict).select(name(".json"), F.to_json(F.struct(F.lit("normalized-v2").alias("format"), F.lit("chat").alias("source"), F.lit("front").alias("source_route"), F.col("items").alias("messages"))).alias("value"))
    message = F.struct(uid.alias("uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), stamp.alias("created_at"), F.col("text"))
    export = of(2, message).select(name(".json"), F.to_json(F.array(F.struct(F.concat(F.lit("c"), S("conv_id")).alias("uuid"), F.lit("2024-02-01").alias("updated_at"), F.col("items").alias("chat_messages")))).alias("value"))
    part = F.concat(F.lpad((F.col("turn") + 1).cast("string"), 2, "0"), F.when(F.col("role") == "user", "L").otherwise("C"), F.lit("\n"), F.col("text"), F.lit("\n"))
    transcript = of(3, part).select(name(".txt"), F.array_join("items", "").alias("value"))
    plain = F.struct("role", "text", stamp.alias("timestamp"), F.col("turn").cast("long").alias("round"), F.concat(F.lit("p"), n).alias("session"))
    legacy = of(4, plain).select(name(".json"), F.to_json("items").alias("value"))
    return journal.unionByName(envelope).unionByName(export).unionByName(transcript).unionByName(legacy)


@query("SELECT session_id, role, CAST(rnd AS BIGINT) AS round, row_number() OVER (PARTITION BY session_id, rnd ORDER BY ord) AS message_seq FROM num_t", **FAMILY)
def mixed_load(c):
    """Files of five families in one load, numbered in one pass."""
    return mixed.load(files(c), {"front": "hall"}).select("session_id", "role", "round", "message_seq")


@query("SELECT session_id, source_uuid FROM turns WHERE session_id % 9 <> 0")
def reconcile_files(c):
    """Candidates of files that are still there: every ninth session's file is gone."""
    rows = c.turns.withColumn("file", F.concat(F.lit("/f/"), S("session_id")))
    listing = rows.where("session_id % 9 <> 0").select("file").distinct()
    return ingest.vanished(rows, listing).select("session_id", "source_uuid")


@query("SELECT session_id, source_uuid FROM turns WHERE round > 3")
def stale_turns(c):
    """Stored turns of which only the first three rounds are eligible any more."""
    return ingest.stale_turns(c.turns, c.turns.where("round <= 3")).select("session_id", "source_uuid")


@query("SELECT t.session_id, c.covered_round, t.max_round, coalesce(c.covered_round >= t.max_round, false) AS done FROM (SELECT session_id, max(round) AS max_round FROM turns GROUP BY session_id) t LEFT JOIN (SELECT session_id, CAST(max(turn_end) AS BIGINT) AS covered_round FROM cards GROUP BY session_id) c ON c.session_id = t.session_id")
def covered_sessions(c):
    return cd.covered(c.cards, c.turns)


@query(
    r"""SELECT session_id, lo, trim(string_agg(CASE WHEN message_seq = 1 THEN (CASE WHEN round > lo THEN chr(10) ELSE '' END) || 'R' || round || chr(10) ELSE '' END || CASE WHEN role = 'user' THEN 'Ann' ELSE 'Bot' END || ': ' || CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || ' …' ELSE t END, chr(10) ORDER BY round, message_seq)) AS text
    FROM (SELECT *, 1 + 2 * ((round - 1) // 2) AS lo, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM turns) GROUP BY session_id, lo"""
)
def render_windows(c):
    """Windows of two rounds over every session as text."""
    windows = c.turns.select("session_id", (F.floor((F.col("round") - 1) / 2) * 2 + 1).alias("lo")).distinct().withColumn("hi", F.col("lo") + 1)
    return cd.render_windows(c.turns, windows, {"user": "Ann", "assistant": "Bot"}, 60).select("session_id", "lo", F.trim("text").alias("text"))


@query("SELECT CAST(user_id AS BIGINT) AS session_id, CASE WHEN user_id % 3 = 0 THEN 'old' ELSE 'n' || user_id END AS native_id, 'route' || max_by(event_type, event_id) AS route, max_by('r' || (event_id % 7), event_id) AS room FROM events GROUP BY user_id UNION ALL SELECT -1, 'old', 'kept', 'attic'")
def upsert_sessions(c):
    """Provenance of sessions (users), every third one stored before, with the latest route and room."""
    e = c.table("events")
    new = e.select(F.col("user_id").cast("long").alias("session_id"), F.concat(F.lit("n"), S("user_id")).alias("native_id"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("route"), "event_type").alias("route"), F.concat(F.lit("r"), (F.col("event_id") % 7).cast("string")).alias("room"), F.col("event_id").alias("seq"))
    stored = e.where("user_id % 3 = 0").select(F.col("user_id").cast("long").alias("session_id")).distinct().unionByName(c.spark.range(1).select(F.lit(-1).cast("long").alias("session_id")))
    stored = stored.select("session_id", F.lit("old").alias("native_id"), F.lit("x").alias("parent"), F.lit("kept").alias("route"), F.lit("attic").alias("room"))
    return cd.upsert_sessions(stored, new).select("session_id", "native_id", "route", "room")


@query("SELECT node_id AS source_uuid, role, CASE WHEN role = 'user' THEN 'Ann' ELSE 'Bot' END AS speaker FROM nodes WHERE owner % 2 = 1")
def project_messages(c):
    """Messages of nodes that aren't stored yet (sessions of even number are)."""
    stored = c.forest.where("owner % 2 = 0").select(F.col("node_id").alias("source_uuid"), "role", "text", F.col("occurred_at").alias("ts"))
    return cd.project_messages(c.forest, stored, {"user": "Ann", "assistant": "Bot"}).select("source_uuid", "role", "speaker")


@query("SELECT card_id, doc_id % 3 <> 1 AS cached, sha1('api|m1|' || headline) AS cache_key FROM (SELECT c.card_id, c.headline, max(CASE WHEN d.doc_id % 3 <> 1 THEN 0 ELSE 1 END) OVER (PARTITION BY c.headline) AS x, CASE WHEN min(CASE WHEN d.doc_id % 3 <> 1 THEN 0 ELSE 1 END) OVER (PARTITION BY c.headline) = 0 THEN 0 ELSE 1 END AS doc_id FROM cards c JOIN cards d ON d.card_id = c.card_id)")
def embedding_cache(c):
    """Texts with the vectors that a cache has; equal texts share an entry."""
    from tidewell.functions.labels import cache_key

    cache = c.cards.where("doc_id % 3 <> 1").select(cache_key("api", "m1", F.col("headline")).alias("cache_key"), F.array(F.lit(1.0)).alias("vector"))
    found = models.with_cached(c.cards.select("card_id", F.col("headline").alias("text")), cache, "api", "m1")
    return found.select("card_id", F.col("vector").isNotNull().alias("cached"), "cache_key")


@query("SELECT t.source_uuid, t.session_id, t.round, count(c.card_id) AS n_cards FROM turns t LEFT JOIN cards c ON c.session_id = t.session_id AND t.round BETWEEN c.turn_start AND greatest(c.turn_start, c.turn_end) WHERE t.session_id % 6 = 0 AND t.role = 'user' GROUP BY ALL")
def attempt_impact(c):
    """Failed attempts (users' rows of every sixth session) and the cards that cover them."""
    failed = c.turns.where("session_id % 6 = 0 AND role = 'user'").select(F.col("source_uuid").alias("user_uuid"))
    turns = c.turns.where("session_id % 6 = 0")
    return schema.attempt_impact(failed, turns, c.cards)


@query("SELECT room, count(*) AS n_cards, CASE WHEN room = 'src3' THEN 'skip' ELSE 'run' END AS action FROM cards GROUP BY room")
def room_plan(c):
    return publish.room_plan(c.cards, {"src3": False, "src4": True})


@query("SELECT session_id, round, message_seq, '{\"session_id\":' || session_id || ',\"round\":' || round || ',\"message_seq\":' || message_seq || ',\"source_uuid\":\"' || source_uuid || '\",\"role\":\"' || role || '\",\"timestamp\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"text\":' || to_json(text) || '}' AS line FROM (SELECT *, max(round) OVER (PARTITION BY session_id) AS last FROM turns) WHERE round > last - 2")
def message_lines(c):
    """The last two rounds of each session as JSON lines."""
    return publish.message_lines(c.turns, 2)


BUNDLE = CLOSURE | CONSTANTS | {
    "seen_t": f"SELECT card_id, room FROM cards WHERE {SEEN}",
    "held_t": "SELECT m.* FROM members m JOIN seen_t s ON s.card_id = m.card_id",
}


@query(
    f"""SELECT 'cards' AS name, count(*) AS n FROM seen_t UNION ALL SELECT 'card_tags', count(*) FROM card_tags WHERE card_id IN (SELECT card_id FROM seen_t) UNION ALL SELECT 'turns', count(*) FROM ({SPAN} WHERE c.room = '{VIEWER}')
    UNION ALL SELECT 'members', count(*) FROM held_t UNION ALL SELECT 'clusters', count(DISTINCT t.cluster_id) FROM closure_t t JOIN held_t h ON h.cluster_id = t.member UNION ALL SELECT 'summaries', count(DISTINCT t.cluster_id) FROM closure_t t JOIN held_t h ON h.cluster_id = t.member
    UNION ALL SELECT 'constants', count(*) FROM kept_t WHERE active AND (shared OR room = '{VIEWER}')""",
    **BUNDLE,
)
def viewer_bundle(c):
    """How many rows of each table a viewer may take along."""
    from tidewell.operators import midlayer as m

    tables = publish.bundle(c.cards, c.card_tags, c.clusters, c.members, tree.subtree(c.clusters), m.apply_constants(*constants(c), VIEWER), c.turns, VIEWER)
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query(
    """SELECT p.a, p.b, round(greatest(greatest(pmi, 0) / greatest(log2(n), 1e-9), coalesce(s.similarity, 0)), 6) AS assoc FROM tpairs_t p LEFT JOIN near_t s ON s.a = p.a AND s.b = p.b WHERE round(greatest(greatest(pmi, 0) / greatest(log2(n), 1e-9), coalesce(s.similarity, 0)), 6) > 0
    UNION ALL SELECT s.a, s.b, similarity FROM near_t s LEFT JOIN tpairs_t p ON s.a = p.a AND s.b = p.b WHERE p.a IS NULL AND similarity > 0""",
    **PAIRS,
    profile_t="SELECT a AS tag, b AS feature, pmi FROM tpairs_t WHERE pmi > 0 AND df_a >= 2 AND df_b >= 2 UNION ALL SELECT b, a, pmi FROM tpairs_t WHERE pmi > 0 AND df_a >= 2 AND df_b >= 2",
    near_t="SELECT x.a, x.b, round(dot / (na.n * nb.n), 6) AS similarity FROM (SELECT p.tag AS a, q.tag AS b, sum(p.pmi * q.pmi) AS dot FROM profile_t p JOIN profile_t q ON p.feature = q.feature AND p.tag < q.tag GROUP BY ALL) x JOIN (SELECT tag, sqrt(sum(pmi * pmi)) AS n FROM profile_t GROUP BY tag) na ON na.tag = x.a JOIN (SELECT tag, sqrt(sum(pmi * pmi)) AS n FROM profile_t GROUP BY tag) nb ON nb.tag = x.b",
)
def tag_association(c):
    return index.association(index.tag_pairs(c.card_tags))


@query(
    r"""SELECT doc_id, CASE WHEN h IS NULL THEN '' ELSE CASE WHEN s > 0 THEN '…' ELSE '' END || array_to_string(list_transform(w[s + 1 : s + 8], lambda x: CASE WHEN regexp_matches(lower(strip_accents(x)), '(^|[^\p{L}\p{M}\p{N}])thin') THEN '【' || x || '】' ELSE x END), ' ') || CASE WHEN s + 8 < len(w) THEN '…' ELSE '' END END AS snippet
    FROM (SELECT doc_id, w, h, greatest(0, least(h - 2, len(w) - 8)) AS s FROM (SELECT doc_id, w, list_min(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(lower(strip_accents(w[i])), '(^|[^\p{L}\p{M}\p{N}])thin'))) AS h
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)))"""
)
def search_snippets(c):
    show = F.udf(lambda text: se.fts_snippet(text, ["thin"]), "string", useArrow=True)
    return c.table("documents").select("doc_id", show("text").alias("snippet"))


@query("SELECT doc_id, 'a {x} ' || lang || ' {' || source || '} ' || lang AS filled, source || 'b' || chr(10) || 'c' AS plain, '{\"a\":[1,{\"y\":null,\"z\":\"' || lang || '\"}],\"b\":' || doc_id || '}' AS canonical FROM documents")
def text_tools(c):
    """Placeholders, terminal escapes and canonical JSON."""
    docs = c.table("documents")
    filled = k.fill(F.lit("a {x} {lang} {{source}} {lang}"), {"lang": F.col("lang"), "source": F.col("source")})
    plain = k.strip_ansi(F.concat(F.lit("\x1b[1;31m"), F.col("source"), F.lit("\x1b[0mb\x07\n\x1b]0;title\x07c\x00")))
    canonical = k.canonical_json(F.concat(F.lit('{ "b": '), S("doc_id"), F.lit(', "a": [1, {"z": "'), F.col("lang"), F.lit('", "y": null}]}')))
    return docs.select("doc_id", filled.alias("filled"), plain.alias("plain"), canonical.alias("canonical"))


@query(f"SELECT c.card_id, c.session_id, coalesce(t.tags, '') AS tags FROM cards c LEFT JOIN (SELECT card_id, string_agg(tag, '/' ORDER BY tag) AS tags FROM card_tags GROUP BY card_id) t ON t.card_id = c.card_id WHERE {SEEN.replace('room', 'c.room').replace('share', 'c.share')} AND c.doc_id IN (3, 14, 15, 92)")
def card_lookup(c):
    """A look-up of four cards: tags are grouped for these alone."""
    ids = c.cards.where("doc_id IN (3, 14, 15, 92)").select("card_id")
    return browse.card_detail(c.cards, c.card_tags, VIEWER, ids).select("card_id", "session_id", "tags")


@query(
    """SELECT t.session_id, t.source, coalesce(n.new_rounds, 0) AS new_rounds, coalesce(n.new_rounds, 0) >= CASE t.source WHEN 'a' THEN 2 WHEN 'b' THEN 1 ELSE 5 END AND (l.attempt IS NULL OR l.attempt <= TIMESTAMP '2024-01-29 12:00:00' - to_minutes(CASE t.source WHEN 'a' THEN 1440 WHEN 'b' THEN 30 ELSE 60 END)) AS open
    FROM (SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source FROM turns GROUP BY session_id) t LEFT JOIN last_t l ON l.session_id = t.session_id LEFT JOIN (
      SELECT t.session_id, count(DISTINCT round) AS new_rounds FROM turns t LEFT JOIN last_t l ON l.session_id = t.session_id WHERE l.success IS NULL OR t.ts > l.success GROUP BY t.session_id) n ON n.session_id = t.session_id""",
    last_t="SELECT session_id, max(called_at) AS attempt, max(CASE WHEN ok THEN called_at END) AS success FROM model_calls GROUP BY session_id",
)
def gate_by_source(c):
    source = F.when(F.col("session_id") % 3 == 0, "a").when(F.col("session_id") % 3 == 1, "b").otherwise("c")
    return cd.gate_by_source(c.turns.withColumn("source", source), c.model_calls, "2024-01-29 12:00:00", {"a": (2, 1440), "b": (1, 30)})


@query(
    "SELECT node_id, branch FROM late_branch_t",
    late_t="SELECT *, CASE WHEN row_number() OVER (PARTITION BY parent_id ORDER BY CAST(owner < 1000000 AS INTEGER), occurred_at, node_id) = 1 THEN parent_id END AS inherits FROM nodes",
    late_branch_t="RECURSIVE SELECT node_id, node_id AS branch FROM late_t WHERE inherits IS NULL UNION ALL SELECT i.node_id, b.branch FROM late_t i JOIN late_branch_t b ON i.inherits = b.node_id",
)
def branches_by_arrival(c):
    """Forked children arrived in the batch before their parents' own continuation."""
    return tree.branches(c.forest.withColumn("batch", (F.col("owner") < 1_000_000).cast("int")))


@query(
    """SELECT d.doc_id, coalesce(r.room, o.room) AS room FROM documents d LEFT JOIN (SELECT DISTINCT source, lang AS route, 'room-' || lang AS room FROM documents WHERE lang IN ('en', 'de')) r ON r.source = d.source AND r.route = d.lang
    LEFT JOIN (SELECT DISTINCT source, 'room-' || lang AS room FROM documents WHERE lang IN ('en', 'de')) o ON o.source = d.source AND o.room = CASE WHEN d.doc_id % 2 = 0 THEN 'room-de' ELSE 'elsewhere' END"""
)
def routed_rooms(c):
    """Rooms by source and route (lang); for a route that the policy lacks, the row's own room where its source may have it."""
    docs = c.table("documents")
    policy = docs.where("lang IN ('en', 'de')").select("source", F.col("lang").alias("route"), F.concat(F.lit("room-"), "lang").alias("room")).distinct()
    rows = docs.select("doc_id", "source", F.col("lang").alias("route"), F.when(F.col("doc_id") % 2 == 0, "room-de").otherwise("elsewhere").alias("room"))
    return violations.with_room(rows, policy).select("doc_id", "room")


@query("SELECT name, before, after FROM (SELECT source AS name, count(*) AS before FROM documents GROUP BY source) b FULL JOIN (SELECT source AS name, count(*) AS after FROM documents WHERE lang <> 'fr' AND source <> 'src1' GROUP BY source) a USING (name) WHERE before IS DISTINCT FROM after")
def state_changes(c):
    docs = c.table("documents")
    count = lambda rows: rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return violations.state_changes(count(docs), count(docs.where("lang <> 'fr' AND source <> 'src1'")))


@query("SELECT session_id, card_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_start, card_ts, card_id) AS INTEGER) AS k FROM cards")
def session_cards(c):
    return browse.session_cards(c.cards)


@query('SELECT session_id AS "group", pos, headline FROM (SELECT session_id, -doc_id AS pos, headline, row_number() OVER (PARTITION BY session_id ORDER BY -doc_id) AS k FROM cards) WHERE k <= 2')
def headlines_in_order(c):
    """Two headlines of each session, the newest ids first; ids that are no cards are passed over."""
    ids = c.cards.select(F.col("session_id").alias("group"), "card_id", (-F.col("doc_id")).alias("pos"))
    strange = ids.select("group", F.concat("card_id", F.lit("x")).alias("card_id"), (F.col("pos") - 1).alias("pos"))
    return browse.headlines(ids.unionByName(strange), c.cards, 2)


#: A session's turns lie in the files session_id % 50 and, for every third session, the next one.
FILES = {
    "pairs_f": "SELECT DISTINCT 'f' || (session_id % 50) AS file, session_id AS session FROM turns UNION SELECT DISTINCT 'f' || (session_id % 50 + 1), session_id FROM turns WHERE session_id % 3 = 0 AND session_id % 7 = 0",
    "reach_f": "RECURSIVE SELECT 'f3' AS file UNION SELECT q.file FROM reach_f r JOIN pairs_f p ON p.file = r.file JOIN pairs_f q ON q.session = p.session",
}


@query("SELECT file FROM reach_f WHERE file IN (SELECT file FROM pairs_f)", **FILES)
def files_to_read_again(c):
    """All files that share sessions, over any number of steps, with one that changed."""
    name = lambda n: F.concat(F.lit("f"), n.cast("string")).alias("file")
    one = c.turns.select(name(F.col("session_id") % 50), "session_id")
    two = c.turns.where("session_id % 3 = 0 AND session_id % 7 = 0").select(name(F.col("session_id") % 50 + 1), "session_id")
    changed = c.spark.range(1).select(F.lit("f3").alias("file"))
    return components.touched_files(browse.file_sessions(one.unionByName(two)), changed)


@query(
    "SELECT entity, CASE WHEN lower(entity) IN ('therea', 'thatth') THEN 'stop word' ELSE 'generic' END AS reason FROM (SELECT entity, count(*) AS df FROM (SELECT DISTINCT card_id, entity FROM card_tags JOIN tag_map USING (tag)) GROUP BY entity), (SELECT count(*) AS n FROM cards) WHERE lower(entity) IN ('therea', 'thatth') OR df > 0.01 * n"
)
def generic_entities(c):
    n = c.cards.agg(F.count("*").alias("n"))
    return index.generic_entities(index.card_entities(c.card_tags, c.tag_map), n, {"therea", "thatth"}, 0.01)
