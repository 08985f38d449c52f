"""Registered queries: journals, archives, envelopes and rules, over lines that are made of the conversations table."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.operators import violations as v
from tidewell.sources import envelopes as e
from tidewell.sources import journal as j
from tidewell.plans.registry import query

S = lambda x: F.col(x).cast("string")


def uid(conv, turn):
    return F.concat(F.lit("u"), conv.cast("string"), F.lit("-"), turn.cast("string"))


def journal(c):
    """Lines of a journal: a line for each message; every 11th conversation ends in a failed attempt, every 13th has a broken line, system rows are meta;
    every fifth has reminders behind the user's words, every seventh a command's echo, and a cursor at its last message."""
    conv = c.table("conversations")
    t, n = F.col("turn"), F.col("conv_id")
    first = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) == 1
    rows = conv.withColumn("parent", F.when(~first, F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn"))))
    stamp = F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int), 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    content = F.when((F.col("role") == "user") & (n % 5 == 1), F.concat("text", F.lit("\n<system-reminder>not\nsaid</system-reminder>"))).otherwise(F.col("text"))
    said = rows.select("conv_id", "turn", F.to_json(F.struct(
        uid(n, t).alias("uuid"), F.when(F.col("parent").isNotNull(), uid(n, F.col("parent"))).alias("parentUuid"), F.concat(F.lit("s"), S("conv_id")).alias("sessionId"), stamp.alias("timestamp"),
        F.col("role").alias("type"), (F.col("role") == "system").alias("isMeta"), F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"), content.alias("content")).alias("message"),
    )).alias("value"))
    ends = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    failed = ends.where("conv_id % 11 = 0").select("conv_id", (F.col("last") + 1).alias("turn"), F.to_json(F.struct(uid(n, F.col("last") + 1).alias("uuid"), uid(n, F.col("last")).alias("parentUuid"), F.concat(F.lit("s"), S("conv_id")).alias("sessionId"), F.lit("2025-01-01T00:00:00Z").alias("timestamp"), F.lit(True).alias("isApiErrorMessage"), F.struct(F.lit("assistant").alias("role"), F.lit("failed").alias("content")).alias("message"))).alias("value"))
    broken = ends.where("conv_id % 13 = 0").select("conv_id", (F.col("last") + 2).alias("turn"), F.lit('{"uuid": "half').alias("value"))
    echo = ends.where("conv_id % 7 = 2").select("conv_id", (F.col("last") + 3).alias("turn"), F.to_json(F.struct(
        uid(n, F.col("last") + 3).alias("uuid"), uid(n, F.col("last")).alias("parentUuid"), F.concat(F.lit("s"), S("conv_id")).alias("sessionId"), F.lit("2025-01-01T00:00:01Z").alias("timestamp"), F.lit("user").alias("type"),
        F.struct(F.lit("user").alias("role"), F.lit("<command-name>/model</command-name>\n<command-args>a-b.c</command-args>").alias("content")).alias("message"),
    )).alias("value"))
    cursor = ends.where("conv_id % 7 = 2").select("conv_id", (F.col("last") + 4).alias("turn"), F.to_json(F.struct(F.lit("last-prompt").alias("type"), F.concat(F.lit("s"), S("conv_id")).alias("sessionId"), uid(n, F.col("last")).alias("leafUuid"))).alias("value"))
    lines = said.unionByName(failed).unionByName(broken).unionByName(echo).unionByName(cursor)
    return lines.select(F.concat(F.lit("/journals/"), S("conv_id"), F.lit(".jsonl")).alias("path"), F.col("turn").cast("int").alias("line_no"), "value")


LAST = {"last_t": "SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id"}


@query("SELECT 'u' || c.conv_id || '-' || turn AS uuid, role, trim(text) AS text FROM conversations c JOIN last_t l ON l.conv_id = c.conv_id WHERE role <> 'system' AND NOT (c.conv_id % 11 = 0 AND turn = last)", **LAST)
def scan_filter_noise(c):
    return j.messages(j.parse_lines(journal(c))).select("uuid", "role", F.trim("text").alias("text"))


@query(
    """SELECT 'u' || conv_id || '-' || turn AS uuid, CASE WHEN role = 'system' THEN 'event' ELSE 'message' END AS kind FROM conversations
    UNION ALL SELECT 'u' || conv_id || '-' || (last + 1), 'event' FROM last_t WHERE conv_id % 11 = 0
    UNION ALL SELECT 'u' || conv_id || '-' || (last + 3), 'event' FROM last_t WHERE conv_id % 7 = 2""",
    **LAST,
)
def node_kind(c):
    return j.parse_lines(journal(c)).where("NOT bad AND uuid IS NOT NULL").select("uuid", j.node_kind().alias("kind"))


def native(expression: str) -> str:
    return f"'u' || conv_id || '-' || {expression}"


def node_sql(expression: str) -> str:
    return f"'node:' || substr(sha256('journal|r1|u' || conv_id || '-' || {expression}), 1, 32)"


@query(
    f"""SELECT {native('turn')} AS native_id, 'u' || conv_id || '-' || lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, CASE WHEN role = 'system' THEN 'event' ELSE 'message' END AS kind,
      CASE WHEN role <> 'system' THEN role END AS role, CASE WHEN role = 'user' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') WHEN role = 'assistant' THEN text END AS text, {node_sql('turn')} AS node_id FROM conversations
    UNION ALL SELECT {native('(last + 1)')}, {native('last')}, 'event', NULL, NULL, {node_sql('(last + 1)')} FROM last_t WHERE conv_id % 11 = 0
    UNION ALL SELECT {native('(last + 3)')}, {native('last')}, 'event', NULL, NULL, {node_sql('(last + 3)')} FROM last_t WHERE conv_id % 7 = 2""",
    **LAST,
)
def tree_from_journal(c):
    return j.tree_from_journal(j.parse_lines(journal(c)).where("NOT bad"), "r1")[0].select("native_id", "parent", "kind", "role", "text", "node_id")


@query(f"SELECT 's' || conv_id AS context, {node_sql('last')} AS node_id FROM last_t WHERE conv_id % 7 = 2", **LAST)
def journal_cursors(c):
    return j.tree_from_journal(j.parse_lines(journal(c)).where("NOT bad"), "r1")[1].select("context", "node_id")


@query("SELECT 'u' || conv_id || '-' || last AS user_uuid, 'u' || conv_id || '-' || (last + 1) AS error_uuid FROM last_t JOIN conversations c USING (conv_id) WHERE conv_id % 11 = 0 AND c.turn = last AND c.role <> 'assistant'", **LAST)
def failed_attempts(c):
    return j.failed_attempts(j.parse_lines(journal(c)).where("NOT bad"))


RETRY = {
    "tried_t": "SELECT event_id // 8 AS g, event_id, 'e' || event_id AS uuid, ts, event_type AS kind FROM events WHERE event_type <> 'view' AND (event_type <> 'click' OR event_id IN (SELECT max(event_id) FROM events WHERE event_type = 'click' GROUP BY event_id // 8))",
    "group_t": "SELECT g, 'p' || g AS above, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'purchase') AS answers, max(ts) FILTER (kind = 'error') AS last_error, max(ts) FILTER (kind = 'purchase') AS answered, min(uuid) FILTER (kind = 'purchase') AS answer, 'e' || min(event_id) FILTER (kind = 'error') AS first_error FROM tried_t GROUP BY g",
    "chain_t": "SELECT t.g, t.uuid, lag(t.uuid) OVER (PARTITION BY t.g ORDER BY t.kind = 'purchase', ts, t.uuid) AS before FROM tried_t t JOIN group_t g ON g.g = t.g WHERE kind IN ('error', 'purchase') AND errors > 0 AND answers = 1 AND last_error < answered",
}


def attempts(c):
    """Journal lines in groups of eight events below one parent: errors, answers (purchase), the user's own forks (signup), and a stop hook (click) below the first error."""
    e = c.table("events").withColumn("g", F.floor(F.col("event_id") / 8))
    group = W.partitionBy("g")
    first = F.min(F.when(F.col("event_type") == "error", F.col("event_id"))).over(group)
    hook = F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).over(group)
    rows = e.withColumn("first", first).withColumn("hook", hook).where("event_type <> 'view' AND (event_type <> 'click' OR event_id = hook)")
    above, kind = F.concat(F.lit("p"), S("g")), F.col("event_type")
    return rows.select(
        F.concat(F.lit("e"), S("event_id")).alias("uuid"), F.when((kind == "click") & F.col("first").isNotNull(), F.concat(F.lit("e"), S("first"))).otherwise(above).alias("parentUuid"), F.lit(None).cast("string").alias("logicalParentUuid"),
        F.concat(F.lit("s"), S("g")).alias("sessionId"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"), F.concat(F.lit("/j/"), (F.col("g") % 5).cast("string")).alias("path"),
        F.when(kind == "purchase", "assistant").when(kind == "signup", "user").otherwise("system").alias("type"), F.when(kind == "error", "api_error").when(kind == "click", "stop_hook_summary").alias("subtype"),
    )


@query(
    """SELECT t.uuid, CASE WHEN c.before IS NOT NULL THEN c.before WHEN kind = 'click' AND c2.uuid IS NOT NULL AND t.ts >= answered THEN answer WHEN kind = 'click' THEN coalesce(first_error, above) ELSE above END AS parent
    FROM tried_t t JOIN group_t g ON g.g = t.g LEFT JOIN chain_t c ON c.uuid = t.uuid LEFT JOIN chain_t c2 ON c2.uuid = g.answer""",
    **RETRY,
)
def retry_linearize(c):
    return j.linearized(attempts(c)).select("uuid", "parent")


def archive(c, sound=False):
    """Two exports: the second holds every conversation again, later for every third one; unless sound, every 17th lacks its last message there and every 19th is edited."""
    conv = c.table("conversations")
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    both = conv.join(last, "conv_id").withColumn("snap", F.explode(F.array(F.lit(0), F.lit(1)))).where(F.lit(sound) | F.expr("NOT (snap = 1 AND conv_id % 17 = 0 AND turn = last)"))
    both = both.withColumn("text", F.when(F.expr("snap = 1 AND conv_id % 19 = 5") & F.lit(not sound), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    message = F.struct(uid(F.col("conv_id"), F.col("turn")).alias("uuid"), F.when(F.col("turn") > 0, uid(F.col("conv_id"), F.col("turn") - 1)).alias("parent_message_uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.col("text"))
    chats = both.groupBy("snap", "conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("chat_messages"))
    chat = F.struct(F.concat(F.lit("c"), S("conv_id")).alias("uuid"), F.concat(F.lit("2024-02-0"), F.when((F.col("snap") == 1) & (F.col("conv_id") % 3 == 0), "2").otherwise("1")).alias("updated_at"), "chat_messages")
    return chats.select(F.concat(F.lit("/exports/"), S("snap"), F.lit("-"), S("conv_id"), F.lit(".json")).alias("path"), F.to_json(F.array(chat)).alias("value"))


def archive_tables(sound: bool) -> dict[str, str]:
    text, whole = ("text", "true") if sound else ("CASE WHEN snap = 1 AND c.conv_id % 19 = 5 THEN text || ' edited' ELSE text END AS text", "NOT (snap = 1 AND c.conv_id % 17 = 0 AND turn = last)")
    return {
        "exported_t": f"""SELECT snap, c.conv_id, turn, role, {text}, '2024-02-0' || CASE WHEN snap = 1 AND c.conv_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at, count(*) OVER (PARTITION BY snap, c.conv_id) AS size
          FROM conversations c JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) l ON l.conv_id = c.conv_id, (SELECT unnest([0, 1]) AS snap) WHERE {whole}""",
        "chosen_t": "SELECT conv_id, snap FROM (SELECT DISTINCT conv_id, snap, row_number() OVER (PARTITION BY conv_id ORDER BY updated_at DESC, size DESC, '/exports/' || snap) AS k FROM (SELECT DISTINCT conv_id, snap, updated_at, size FROM exported_t)) WHERE k = 1",
    }


ARCHIVE = archive_tables(False)
SOUND = archive_tables(True) | {"tree_t": "SELECT x.*, lag(turn) OVER (PARTITION BY x.conv_id ORDER BY turn) AS prev FROM exported_t x JOIN chosen_t c ON c.conv_id = x.conv_id AND c.snap = x.snap WHERE role <> 'system'"}


@query(r"SELECT '/exports/' || snap || '-' || conv_id || '.json' AS path, 'u' || conv_id || '-' || turn AS uuid, role, text FROM exported_t WHERE role <> 'system' AND regexp_matches(text, '\S')", **ARCHIVE)
def scan_export(c):
    return e.export_messages(archive(c)).select("path", "uuid", "role", "text")


@query("SELECT 'c' || conv_id AS session, '/exports/' || snap || '-' || conv_id || '.json' AS path FROM chosen_t WHERE conv_id IN (SELECT conv_id FROM exported_t WHERE role <> 'system')", **ARCHIVE)
def snapshot_select(c):
    files = archive(c)
    return e.snapshot_select(e.export_messages(files), e.export_snapshots(files)).select("session", "path")


@query(
    """SELECT DISTINCT 'c' || conv_id AS session, CASE WHEN conv_id % 17 = 0 THEN 'omits earlier nodes' ELSE 'ambiguous snapshots' END AS problem FROM conversations c WHERE role <> 'system' AND (
      conv_id % 17 = 0 AND conv_id % 3 = 0 AND turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id) OR conv_id % 19 = 5 AND conv_id % 3 <> 0 AND conv_id % 17 <> 0)"""
)
def snapshot_problems(c):
    files = archive(c)
    return e.snapshot_problems(e.export_messages(files), e.export_snapshots(files))


@query(
    r"""SELECT 'node:' || substr(sha256('archive|r2|u' || conv_id || '-' || turn), 1, 32) AS node_id, CASE WHEN prev = turn - 1 THEN 'node:' || substr(sha256('archive|r2|u' || conv_id || '-' || (turn - 1)), 1, 32) END AS parent_id, role, turn > 0 AND prev IS DISTINCT FROM turn - 1 AS detached
    FROM tree_t""",
    **SOUND,
)
def archive_tree(c):
    files = archive(c, True)
    return e.archive_tree(e.export_messages(files), "r2", snaps=e.export_snapshots(files)).select("node_id", "parent_id", "role", "detached")


@query(
    """SELECT s.*, t.* FROM (SELECT count(DISTINCT snap || '-' || conv_id) AS files, count(DISTINCT snap || '-' || conv_id) AS snapshots, count(DISTINCT conv_id) AS contexts, count(DISTINCT snap || '-' || conv_id) - count(DISTINCT conv_id) AS superseded FROM exported_t WHERE role <> 'system') s,
      (SELECT count(*) AS nodes, count(*) FILTER (prev IS DISTINCT FROM turn - 1) AS roots, count(*) FILTER (turn > 0 AND prev IS DISTINCT FROM turn - 1) AS detached_roots, '2024-01-01T00:00:00.000000Z' AS first_at, '2024-01-01T00:00:00.000000Z' AS last_at FROM tree_t) t""",
    **SOUND,
)
def archive_report(c):
    rows = e.export_messages(archive(c, True))
    return e.archive_report(rows, e.archive_tree(rows, "r2"))


@query(
    """SELECT count(*) FILTER (NOT lost) AS turns, count(*) AS messages, 0 AS missing_in_tree, count(*) FILTER (lost) AS missing_in_turns, 0 AS role_differs, 0 AS text_differs, 0 AS replayed
    FROM (SELECT c.conv_id % 11 = 0 AND turn = last AS lost FROM conversations c JOIN last_t l ON l.conv_id = c.conv_id WHERE role <> 'system')""",
    **LAST,
)
def audit_parity(c):
    """The loader and the tree's adapter on the same journal lines, the adapter a second time on the lines twice; the loader alone drops a row whose answer failed."""
    return j.parity(j.parse_lines(journal(c)))


@query(
    r"""SELECT 'duplicate' AS rule, text AS key FROM documents GROUP BY text HAVING count(*) > 1
    UNION ALL SELECT 'conflict', source FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1
    UNION ALL SELECT 'changed', CAST(doc_id AS VARCHAR) FROM documents WHERE lang = 'de'
    UNION ALL SELECT 'negative sequence', CAST(vec_id % 7 AS VARCHAR) FROM embeddings WHERE label = 0
    UNION ALL SELECT 'sequence twice', CAST(vec_id % 7 AS VARCHAR) FROM embeddings GROUP BY vec_id % 7, label - 1 HAVING count(*) > 1
    UNION ALL SELECT 'unknown room', source FROM documents WHERE lang = 'fr'"""
)
def violations(c):
    docs, emb = c.table("documents"), c.table("embeddings")
    new = docs.withColumn("lang", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("lang")))
    rooms = docs.where("lang <> 'fr'").select(F.col("lang").alias("source"), F.col("source").alias("room")).distinct()
    seq = emb.select((F.col("vec_id") % 7).alias("session"), (F.col("label") - 1).alias("seq"))
    return v.all_of(
        v.duplicates(docs, "text"), v.conflicting(docs, "source", ["lang"]), v.changed(docs, new, "doc_id", ["lang"]), v.bad_sequence(seq, "session", "seq"),
        v.unknown_room(docs.select(F.col("lang").alias("source"), F.col("source").alias("room")), rooms),
    )
