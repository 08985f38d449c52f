"""Runtime journals: one JSON object a line, read into messages or into conversation nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import blank, canonical_id, clean_user_text

#: Content may be a string or an array of blocks, so it is kept as JSON text.
LINE = (
    "uuid STRING, parentUuid STRING, sessionId STRING, timestamp STRING, type STRING, subtype STRING, message STRUCT<role: STRING, content: STRING>, "
    "toolUseResult STRING, isMeta BOOLEAN, isCompactSummary BOOLEAN, isVisibleInTranscriptOnly BOOLEAN, isApiErrorMessage BOOLEAN, error STRING, logicalParentUuid STRING, leafUuid STRING, provider STRING, model STRING"
)
BLOCKS = "ARRAY<STRUCT<type: STRING, text: STRING>>"


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, modified, line_no, value): lines numbered from 0 within their file, blank ones counted and left out.

    Files are read in splits, so a large one is many tasks' work; a line's place is its split's first byte and its place in that split.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    placed = text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.rtrim("value", F.lit("\r")).alias("value")
    )
    number = (F.row_number().over(W.partitionBy("path").orderBy("_block", "_at")) - 1).cast("int")
    return placed.withColumn("line_no", number).where(~blank(F.col("value"))).select("path", "modified", "line_no", "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines with the journal's fields; bad: the line is no JSON object."""
    parsed = lines.withColumn("j", F.from_json("value", LINE, {"mode": "PERMISSIVE"})).withColumn("bad", F.try_parse_json("value").isNull() | ~F.col("value").rlike(r"^\s*\{"))
    return parsed.select(*[c for c in lines.columns if c != "value"], "j.*", "bad")


def text_of(content: Column) -> Column:
    """The text blocks of a content, one a line; a plain string as it is."""
    blocks = F.filter(F.from_json(content, BLOCKS), lambda b: b["type"] == "text")
    return F.when(content.startswith("["), F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")).otherwise(content)


def image_count(content: Column) -> Column:
    return F.when(content.startswith("["), F.size(F.filter(F.from_json(content, BLOCKS), lambda b: b["type"] == "image"))).otherwise(0)


def messages(parsed: DataFrame) -> DataFrame:
    """Turn candidates: broken lines, tools, meta rows, summaries, hidden rows and errors go, and so does the user row whose attempt failed."""
    good = parsed.where("NOT bad")
    failed = good.where(F.coalesce("isApiErrorMessage", F.lit(False)) & F.col("parentUuid").isNotNull()).select(F.col("parentUuid").alias("uuid")).distinct()
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    noise = flag("isMeta") | flag("isCompactSummary") | flag("isVisibleInTranscriptOnly") | flag("isApiErrorMessage") | F.col("toolUseResult").isNotNull() | F.col("error").isNotNull()
    said = good.where(F.col("message.role").isin("user", "assistant") & ~noise & F.col("uuid").isNotNull()).join(failed, "uuid", "left_anti")
    text = text_of(F.col("message.content"))
    rows = said.select("path", "line_no", "uuid", "parentUuid", "sessionId", "timestamp", F.col("message.role").alias("role"), F.when(F.col("message.role") == "user", clean_user_text(text)).otherwise(text).alias("text"))
    return rows.where(~blank(F.col("text")))


def node_kind() -> Column:
    """checkpoint, event, tool or message, in this order of precedence."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    content = F.coalesce(F.col("message.content"), F.lit(""))
    has_tool = F.col("toolUseResult").isNotNull() | content.rlike(r'"type"\s*:\s*"tool_(use|result)"')
    compaction = flag("isCompactSummary") | (F.col("subtype") == "compact_boundary")
    silent = flag("isMeta") | flag("isVisibleInTranscriptOnly") | flag("isApiErrorMessage") | F.col("error").isNotNull()
    said = F.col("message.role").isin("user", "assistant") & portable_text(F.col("message.content"), F.col("message.role")).isNotNull()
    return F.when(F.coalesce(compaction, F.lit(False)), "checkpoint").when(silent, "event").when(F.coalesce(has_tool, F.lit(False)), "tool").when(F.coalesce(said, F.lit(False)), "message").otherwise("event")


def stamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _fail(when: Column, problem: str, key: Column, value: Column) -> Column:
    """value, or an error that names the key: a rule that is broken stops the load and is never repaired in silence."""
    return F.when(when, F.raise_error(F.concat(F.lit(f"{problem}: "), F.coalesce(key.cast("string"), F.lit("null"))))).otherwise(value)


def parent_overrides(rows: DataFrame) -> DataFrame:
    """(path, uuid, parent): parents that a runtime's own records name in place of parentUuid.

    A compaction boundary hangs below its logical parent.  Where below one parent errors and exactly one assistant's row stand, all
    errors before it, that is one answer after failed attempts: the errors, by time, and then the answer become a chain, and a
    stop hook below one of the errors that is no older than the answer hangs below the answer.  Other siblings are
    forks and stay.  Two hooks, or two parents for one row of a file, are an error.
    """
    known = rows.where("uuid IS NOT NULL")
    system = lambda kind: F.coalesce((F.col("type") == "system") & (F.col("subtype") == kind), F.lit(False))
    logical = known.where(system("compact_boundary") & F.col("logicalParentUuid").isNotNull()).select("path", "uuid", F.col("logicalParentUuid").alias("parent"))
    below = known.where("sessionId IS NOT NULL AND parentUuid IS NOT NULL").select("path", "sessionId", "parentUuid", "uuid", stamp(F.col("timestamp")).alias("ts"), system("api_error").alias("error"), (F.col("type") == "assistant").alias("answer"), system("stop_hook_summary").alias("hook"))
    group = ["path", "sessionId", "parentUuid"]
    tried = below.where("error OR answer").join(below.where("error").select(*group).distinct(), group, "left_semi")
    whole = W.partitionBy(*group)
    answers, answered = F.sum(F.col("answer").cast("int")).over(whole), F.max(F.when(F.col("answer"), F.col("ts"))).over(whole)
    early = F.min(F.when(F.col("error"), F.coalesce(F.col("ts") < F.col("answered"), F.lit(False))).cast("int")).over(whole) == 1
    good = tried.withColumn("answers", answers).withColumn("answered", answered).where("answers = 1").withColumn("early", early).where("early")
    order = whole.orderBy("answer", "ts", "uuid")
    chain = good.withColumn("parent", F.lag("uuid").over(order)).withColumn("answer_id", F.max(F.when(F.col("answer"), F.col("uuid"))).over(whole))
    hooks = below.where("hook").select("path", "sessionId", F.col("parentUuid").alias("error_id"), F.col("uuid").alias("hook_id"), F.col("ts").alias("hook_ts"))
    errors = chain.where("error").select("path", "sessionId", F.col("uuid").alias("error_id"), "parentUuid", "answer_id", "answered")
    found = errors.join(hooks, ["path", "sessionId", "error_id"]).where("hook_ts >= answered")
    hooked = found.groupBy("path", "sessionId", "parentUuid", "answer_id").agg(F.count("*").alias("n"), F.min("hook_id").alias("uuid"))
    hooked = hooked.select("path", "uuid", _fail(F.col("n") > 1, "ambiguous stop hooks below", F.col("parentUuid"), F.col("answer_id")).alias("parent"))
    every = logical.unionByName(chain.where("parent IS NOT NULL").select("path", "uuid", "parent")).unionByName(hooked)
    one = every.groupBy("path", "uuid").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
    return one.select("path", "uuid", _fail(F.col("parent") != F.col("other"), "conflicting parents of", F.col("uuid"), F.col("parent")).alias("parent"))


def linearized(rows: DataFrame) -> DataFrame:
    """rows with parent: the override of `parent_overrides`, or parentUuid."""
    over = parent_overrides(rows).select("path", "uuid", F.col("parent").alias("_over"))
    return rows.join(over, ["path", "uuid"], "left").withColumn("parent", F.coalesce("_over", "parentUuid")).withColumn("overridden", F.col("_over").isNotNull()).drop("_over")


def portable_text(content: Column, role: Column) -> Column:
    """What a message says: a user's text without injected parts; blank text is null."""
    text = F.when(role == "user", clean_user_text(text_of(content))).otherwise(text_of(content))
    return F.when(~blank(text), text)


def conflicts(rows: DataFrame) -> DataFrame:
    """(uuid, problem) of rows with parent, overridden, kind and role: copies of a uuid that differ in what they say, name several
    parents of which not exactly one is no compaction, or name a parent that isn't there."""
    return _resolved(rows).select("uuid", _problem().alias("problem")).where("problem IS NOT NULL")


def _resolved(rows: DataFrame) -> DataFrame:
    """(uuid, contents, overrides, parents, plain, over, missing, f): plain: parents that are no compactions; f: the earliest copy."""
    compaction = rows.where(F.coalesce("isCompactSummary", F.lit(False))).select(F.col("uuid").alias("parent")).distinct().withColumn("_c", F.lit(True))
    marked = rows.join(compaction, "parent", "left")
    said = F.struct(stamp(F.col("timestamp")).alias("ts"), "kind", "type", F.col("message.role").alias("role"), portable_text(F.col("message.content"), F.col("message.role")).alias("text"))
    name = F.coalesce("parent", F.lit(""))
    order = F.struct(stamp(F.col("timestamp")).isNull().alias("late"), stamp(F.col("timestamp")).alias("ts"), "path", "line_no")
    fields = F.struct("timestamp", "kind", "type", F.col("message.role").alias("role"), portable_text(F.col("message.content"), F.col("message.role")).alias("text"), "sessionId")
    grouped = marked.groupBy("uuid").agg(
        F.size(F.collect_set(F.sha2(F.to_json(said).cast("binary"), 256))).alias("contents"), F.collect_set(F.when(F.col("overridden"), name)).alias("overrides"),
        F.collect_set(F.when(~F.col("overridden"), name)).alias("parents"), F.collect_set(F.when(~F.col("overridden") & F.col("_c").isNull(), name)).alias("plain"), F.min_by(fields, order).alias("f"),
    )
    one = F.when(F.size("overrides") > 0, F.col("overrides")[0]).when(F.size("parents") == 1, F.col("parents")[0]).when(F.size("plain") == 1, F.col("plain")[0])
    picked = grouped.withColumn("over", F.nullif(one, F.lit("")))
    there = rows.select(F.col("uuid").alias("over"), F.lit(True).alias("_there")).distinct()
    return picked.join(there, "over", "left").withColumn("missing", F.col("over").isNotNull() & F.col("_there").isNull()).drop("_there")


def _problem() -> Column:
    return (
        F.when(F.col("contents") > 1, "conflicting content")
        .when(F.size("overrides") > 1, "conflicting parents")
        .when((F.size("overrides") == 0) & (F.size("parents") > 1) & (F.size("plain") != 1), "ambiguous parents")
        .when(F.col("missing"), "missing parent")
    )


def tree_rows(parsed: DataFrame) -> DataFrame:
    """Rows of a journal with kind, parent and overridden.  A broken line is an error here; a user's row that an error row of the
    runtime names as undelivered is an event."""
    checked = parsed.withColumn("uuid", _fail(F.col("bad"), "no JSON object at", F.concat_ws(":", "path", "line_no"), F.col("uuid")))
    undelivered = checked.where("type = 'phone-error' AND parentUuid IS NOT NULL").select(F.col("parentUuid").alias("uuid"), F.lit(True).alias("_failed")).distinct()
    rows = linearized(checked.where("uuid IS NOT NULL")).join(undelivered, "uuid", "left")
    failed = F.coalesce("_failed", F.lit(False))
    typed = rows.withColumn("kind", F.when(failed, "event").otherwise(node_kind())).withColumn("type", F.when(failed, "user:failed-attempt").when(F.coalesce("isCompactSummary", F.lit(False)), F.concat("type", F.lit(":compact-summary"))).otherwise(F.coalesce("type", F.lit("event"))))
    return typed.drop("_failed")


def tree_from_journal(parsed: DataFrame, room: str, source: str = "journal") -> tuple[DataFrame, DataFrame]:
    """(nodes, cursors).  Copies of a uuid are one node, the earliest; every rule of `conflicts` stops the load with the uuid's name.

    A cursor is a session's last row of type `last-prompt`, by file time, path and line; one that names no node is left out.
    """
    rows = tree_rows(parsed)
    found = _resolved(rows).withColumn("problem", _problem())
    node = lambda c: canonical_id("node", F.lit(source), F.lit(room), c)
    stopped = F.raise_error(F.concat("problem", F.lit(": "), "uuid"))
    native = F.when(F.col("problem").isNotNull(), stopped).otherwise(F.col("uuid"))
    said = F.col("f.kind") == "message"
    nodes = found.select(
        native.alias("native_id"), F.col("over").alias("parent"), "f.timestamp", "f.kind", F.col("f.type").alias("source_type"), F.when(said, F.col("f.role")).alias("role"), F.when(said, F.col("f.text")).alias("text"), "f.sessionId"
    ).withColumn("node_id", node(F.col("native_id")))
    last = parsed.where("type = 'last-prompt' AND sessionId IS NOT NULL AND leafUuid IS NOT NULL")
    seen = F.col("modified") if "modified" in parsed.columns else F.lit(None).cast("timestamp")
    ends = last.withColumn("modified", seen).groupBy("sessionId").agg(F.max(F.struct("modified", "path", "line_no", "leafUuid")).alias("m"))
    ends = ends.select("sessionId", F.col("m.leafUuid").alias("uuid"), F.col("m.modified").alias("observed_at")).join(rows.select("uuid").distinct(), "uuid", "left_semi")
    cursors = ends.select(F.col("sessionId").alias("context"), F.lit(room).alias("room"), F.lit(source).alias("source"), F.lit("cursor").alias("kind"), node(F.col("uuid")).alias("node_id"), "observed_at")
    return nodes, cursors


def parity(parsed: DataFrame, room: str = "room") -> DataFrame:
    """One row of counts: the loader's turns against the tree's messages of the same lines, by id; `replayed`: nodes that a second
    reading of the same lines adds or changes."""
    good = parsed.where("NOT bad")
    turns = messages(good).groupBy("uuid").agg(F.min_by(F.struct("role", "text"), F.struct("path", "line_no")).alias("turn"))
    nodes = tree_from_journal(good, room)[0]
    again = tree_from_journal(good.unionByName(good), room)[0]
    tree = nodes.where("kind = 'message'").select(F.col("native_id").alias("uuid"), F.struct("role", "text").alias("node"))
    both = turns.join(tree, "uuid", "full")
    one = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0)).cast("long")
    counts = both.agg(
        one(F.col("turn").isNotNull()).alias("turns"), one(F.col("node").isNotNull()).alias("messages"), one(F.col("turn").isNotNull() & F.col("node").isNull()).alias("missing_in_tree"),
        one(F.col("turn").isNull()).alias("missing_in_turns"), one(F.col("turn.role") != F.col("node.role")).alias("role_differs"), one(F.col("turn.text") != F.col("node.text")).alias("text_differs"),
    )
    facts = ["native_id", "parent", "kind", "role", "text"]
    new = again.select(*facts).exceptAll(nodes.select(*facts)).agg(F.count("*").alias("replayed"))
    return counts.crossJoin(new)  # one row each


def failed_attempts(rows: DataFrame) -> DataFrame:
    """(user_uuid, error_uuid): user rows whose answer was an error."""
    errors = rows.where(F.coalesce("isApiErrorMessage", F.lit(False))).select(F.col("uuid").alias("error_uuid"), F.col("parentUuid").alias("uuid"))
    return rows.where(F.col("message.role") == "user").join(errors, "uuid").select(F.col("uuid").alias("user_uuid"), "error_uuid")
