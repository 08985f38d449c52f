"""Archive exports, strict envelopes and transcripts; which family a file belongs to; policy of rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import blank, canonical_id, canonical_time

NORMALIZED_TAG, TREE_TAG = "normalized-v2", "conversation-tree-v1"
EXPORT = (
    "ARRAY<STRUCT<uuid: STRING, created_at: STRING, updated_at: STRING, name: STRING, chat_messages: ARRAY<STRUCT<uuid: STRING, parent_message_uuid: STRING, sender: STRING, "
    "created_at: STRING, text: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>>>>>"
)
NORMALIZED = (
    "STRUCT<format: STRING, source: STRING, source_route: STRING, messages: ARRAY<STRUCT<native_session_id: STRING, native_parent_session_id: STRING, native_message_id: STRING, "
    "native_parent_message_id: STRING, role: STRING, text: STRING, occurred_at: STRING, source_sequence: BIGINT, provider: STRING, model: STRING>>>"
)
TREE = (
    "STRUCT<format: STRING, source: STRING, room: STRING, nodes: ARRAY<STRUCT<native_node_id: STRING, native_parent_node_id: STRING, occurred_at: STRING, kind: STRING, source_type: STRING, "
    "message: STRUCT<role: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>, provider: STRING, model: STRING>>>, "
    "observations: ARRAY<STRUCT<native_context_id: STRING, kind: STRING, native_node_id: STRING, observed_at: STRING, payload: MAP<STRING, STRING>>>>"
)
LEGACY = "ARRAY<STRUCT<role: STRING, text: STRING, timestamp: STRING, round: BIGINT, session: STRING>>"


def discover(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, bytes) of files below a folder, oldest first; contents aren't read, and empty files have no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy("modified", "path")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, value): whole files."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def family() -> Column:
    """transcript, tree, normalized, export, legacy or journal, from path and value."""
    head = F.get_json_object("value", "$.format")
    return (
        F.when(F.col("path").endswith(".txt"), "transcript")
        .when(~F.col("path").endswith(".json"), "journal")
        .when(head == TREE_TAG, "tree")
        .when(head == NORMALIZED_TAG, "normalized")
        .when(F.get_json_object("value", "$[0].chat_messages").isNotNull(), "export")
        .otherwise("legacy")
    )


def export_messages(files: DataFrame) -> DataFrame:
    """A row a message of archive exports (path, value): sender and its text, other senders are left out."""
    chats = files.select("path", F.posexplode(F.from_json("value", EXPORT)).alias("chat_index", "c"))
    rows = chats.select("path", "chat_index", F.col("c.uuid").alias("session"), F.col("c.updated_at").alias("updated_at"), F.size("c.chat_messages").alias("size"), F.posexplode("c.chat_messages").alias("index", "m"))
    blocks = F.array_join(F.transform(F.filter(F.col("m.content"), lambda b: (b["type"] == "text") & ~blank(b["text"])), lambda b: b["text"]), "\n")
    text = F.when(F.size("m.content") > 0, blocks).otherwise(F.col("m.text"))
    role = F.when(F.col("m.sender") == "human", "user").when(F.col("m.sender") == "assistant", "assistant")
    return rows.select("path", "chat_index", "session", "updated_at", "size", "index", F.col("m.uuid").alias("uuid"), F.col("m.parent_message_uuid").alias("parent"), role.alias("role"), text.alias("text"), F.col("m.created_at").alias("created_at")).where(F.col("role").isNotNull() & ~blank(F.col("text")))


def export_snapshots(files: DataFrame) -> DataFrame:
    """(session, path, chat_index, updated_at, size) of every conversation in archive exports (path, value), with messages that have a row or without."""
    chats = files.select("path", F.posexplode(F.from_json("value", EXPORT)).alias("chat_index", "c"))
    return chats.select(F.col("c.uuid").alias("session"), "path", "chat_index", F.col("c.updated_at").alias("updated_at"), F.size("c.chat_messages").alias("size"))


def snapshot_select(rows: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """(session, path, chat_index): the latest snapshot of each conversation, then the largest, then the least place.

    snaps: all snapshots (`export_snapshots`), so that one that has lost all its messages can be the latest; without it, those that have rows.
    A conversation without rows in any snapshot is none.
    """
    known = rows.select("session", "path", "chat_index", "updated_at", "size").distinct() if snaps is None else snaps.join(rows.select("session").distinct(), "session", "left_semi")
    w = W.partitionBy("session").orderBy(F.desc("updated_at"), F.desc("size"), "path", "chat_index")
    return known.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("session", "path", "chat_index")


def snapshot_problems(rows: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """(session, problem): a chosen snapshot that lost nodes of another one, or that differs from one as recent and as large; snaps as in `snapshot_select`."""
    chosen = snapshot_select(rows, snaps)
    place = ["session", "path", "chat_index"]
    kept = rows.join(chosen, place, "left_semi")
    lost = rows.join(kept.select("session", "uuid").distinct(), ["session", "uuid"], "left_anti").select("session", F.lit("omits earlier nodes").alias("problem"))
    facts = rows.groupBy(*place, "updated_at", "size").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("uuid", "parent", "role", "text", "created_at")))).cast("binary"), 256).alias("facts"))
    best = facts.join(chosen, place, "left_semi").select("session", F.col("updated_at").alias("at"), F.col("size").alias("most"), F.col("facts").alias("own"))
    differs = facts.join(best, "session").where("updated_at <=> at AND size = most AND facts <> own").select("session", F.lit("ambiguous snapshots").alias("problem"))
    return lost.unionByName(differs).groupBy("session").agg(F.min("problem").alias("problem"))


def archive_tree(rows: DataFrame, room: str, source: str = "archive", snaps: DataFrame | None = None) -> DataFrame:
    """(node_id, parent_id, role, text, occurred_at, session, detached): a parent that isn't there leaves a detached root.

    A conversation with a problem of `snapshot_problems` stops the load; snaps as there.
    """
    stopped = F.raise_error(F.concat("problem", F.lit(": "), "session"))
    chosen = snapshot_select(rows, snaps).join(snapshot_problems(rows, snaps), "session", "left")
    chosen = chosen.select(F.when(F.col("problem").isNotNull(), stopped).otherwise(F.col("session")).alias("session"), "path", "chat_index")
    kept = rows.join(chosen, ["session", "path", "chat_index"], "left_semi")
    known = kept.select("session", F.col("uuid").alias("parent"), F.lit(True).alias("known"))
    linked = kept.join(known, ["session", "parent"], "left")
    node = lambda c: canonical_id("node", F.lit(source), F.lit(room), c)
    return linked.select(node(F.col("uuid")).alias("node_id"), F.when(F.col("known"), node(F.col("parent"))).alias("parent_id"), "role", "text", canonical_time(F.col("created_at")).alias("occurred_at"), "session", (F.col("parent").isNotNull() & F.col("known").isNull()).alias("detached"))


def archive_report(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """One row of counts of an archive load: files, snapshots, contexts, superseded snapshots, nodes, roots, detached roots, first and last time."""
    snaps = rows.select("path", "session", "chat_index").distinct().agg(F.countDistinct("path").alias("files"), F.count("*").alias("snapshots"), F.countDistinct("session").alias("contexts"))
    nodes = tree.agg(
        F.count("*").alias("nodes"), F.sum(F.col("parent_id").isNull().cast("long")).alias("roots"), F.sum(F.col("detached").cast("long")).alias("detached_roots"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"),
    )
    return snaps.withColumn("superseded", F.col("snapshots") - F.col("contexts")).crossJoin(nodes)  # one row each


def normalized_messages(files: DataFrame, room_of_route: dict[str, str]) -> DataFrame:
    """Candidates of strict envelopes; an unknown route or format is an error, never a default."""
    routes = F.create_map(*[F.lit(x) for pair in room_of_route.items() for x in pair]) if room_of_route else F.create_map(F.lit(""), F.lit(""))
    e = files.select("path", F.from_json("value", NORMALIZED, {"mode": "FAILFAST"}).alias("e"))
    checked = e.select("path", "e.*", F.when(F.col("e.format") != NORMALIZED_TAG, F.raise_error(F.lit("unknown format"))).otherwise(F.coalesce(F.try_element_at(routes, F.col("e.source_route")), F.raise_error(F.concat(F.lit("unknown route "), F.col("e.source_route"))))).alias("room"))
    rows = checked.select("path", "source", "room", F.explode("messages").alias("m"))
    # Identities and sequences are the sender's: a repeat, a gap in a name or a number below zero stops the load.
    copies = F.count("*").over(W.partitionBy("source", "m.native_message_id"))
    places = F.count("*").over(W.partitionBy("source", "m.native_session_id", "m.source_sequence"))
    named = ~blank(F.col("m.native_message_id")) & ~blank(F.col("m.native_session_id")) & F.coalesce(F.col("m.role").isin("user", "assistant"), F.lit(False))
    problem = F.when(~named, "no identity or role").when(F.coalesce(F.col("m.source_sequence") < 0, F.lit(True)), "bad sequence").when(F.col("copies") > 1, "message twice").when(F.col("places") > 1, "sequence twice")
    marked = rows.withColumn("copies", copies).withColumn("places", places).withColumn("problem", problem)
    rows = marked.withColumn("source", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat("problem", F.lit(": "), F.coalesce("m.native_message_id", F.lit("null"))))).otherwise(F.col("source")))
    return rows.select(
        "path", "source", "room", canonical_id("session", F.col("source"), F.col("m.native_session_id")).alias("session_id"), canonical_id("message", F.col("source"), F.col("m.native_message_id")).alias("source_uuid"),
        "m.role", "m.text", F.try_to_timestamp("m.occurred_at").alias("ts"), F.col("m.source_sequence").alias("major"), F.col("m.native_message_id").alias("minor"), canonical_time(F.col("m.occurred_at")).alias("occurred_at"),
    )


def tree_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, observations) of strict tree envelopes; another format stops the load."""
    e = files.select(F.from_json("value", TREE, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    strange = F.coalesce(F.col("format") != TREE_TAG, F.lit(True))
    for part in ("nodes", "observations"):
        e = e.withColumn(part, F.when(strange, F.raise_error(F.lit("unknown format"))).otherwise(F.col(part)))
    node = lambda c: canonical_id("node", F.col("source"), F.col("room"), c)
    n = e.select("source", "room", F.explode("nodes").alias("n"))
    nodes = n.select("source", "room", node(F.col("n.native_node_id")).alias("node_id"), F.when(F.col("n.native_parent_node_id").isNotNull(), node(F.col("n.native_parent_node_id"))).alias("parent_id"), canonical_time(F.col("n.occurred_at")).alias("occurred_at"), "n.kind", F.col("n.message.role").alias("role"), F.array_join(F.transform("n.message.content", lambda b: b["text"]), "\n").alias("text"))
    o = e.select("source", "room", F.explode("observations").alias("o"))
    observations = o.select("source", "room", F.col("o.native_context_id").alias("context"), "o.kind", node(F.col("o.native_node_id")).alias("node_id"), canonical_time(F.col("o.observed_at")).alias("observed_at"), F.sha2(F.to_json(F.struct("source", "room", "o")).cast("binary"), 256).alias("observation_id"))
    return nodes, observations


def transcript_messages(files: DataFrame) -> DataFrame:
    """(path, index, round, role, text) of sectioned texts; a header is a line of two digits and L (user) or C (assistant)."""
    parts = F.regexp_extract_all("value", F.lit(r"(?ms)^(\d\d[LC])[ \t]*\r?\n(.*?)(?=^\d\d[LC][ \t]*\r?$|\z)"), F.lit(0))
    rows = files.select("path", F.posexplode(parts).alias("index", "part"))
    head = F.substring("part", 1, 3)
    return rows.select("path", "index", F.substring(head, 1, 2).cast("long").alias("round"), F.when(head.endswith("L"), "user").otherwise("assistant").alias("role"), F.regexp_replace(F.regexp_replace("part", r"^\d\d[LC][ \t]*\r?\n", ""), r"^\s+|\s+$", "").alias("text"))


def legacy_messages(files: DataFrame) -> DataFrame:
    """Candidates of plain arrays; rounds are kept as they are, ids come from path and place."""
    rows = files.select("path", F.posexplode(F.from_json("value", LEGACY)).alias("index", "m"))
    session = F.coalesce(F.col("m.session"), F.col("path"))
    return rows.select("path", "index", canonical_id("session", F.lit("legacy"), session).alias("session_id"), canonical_id("message", F.lit("legacy"), F.col("path"), F.col("index").cast("string")).alias("source_uuid"), "m.role", "m.text", F.try_to_timestamp("m.timestamp").alias("ts"), "m.round")
