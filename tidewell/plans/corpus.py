"""The engine's domain tables, derived from the driver's tables; SQL has the same tables for the oracle.

`Corpus` builds each table once for a (session, folder).  `with_tables` puts the SQL of the tables that a
statement names in front of it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import canonical_id, tokens
from tidewell.operators.index import rarest
from tidewell.operators.rounds import assign_rounds
from tidewell.store import cut, spread

FORK_OFFSET = 1_000_000


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    @cached_property
    def said(self) -> DataFrame:
        """Messages of users and assistants."""
        rows = self.table("conversations").where(F.col("role").isin("user", "assistant"))
        ts = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id AS int), cast(turn AS int), 0)")
        return rows.select("conv_id", "turn", "role", "text", canonical_id("message", F.concat(F.lit("conv|"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))).alias("source_uuid"), ts.alias("ts"))

    @cached_property
    def candidates(self) -> DataFrame:
        """What loaders emit: every session's messages, forked children with a shared prefix, and replayed rows."""
        said = self.said
        cols = lambda session, major: [session.alias("session_id"), "source_uuid", "role", "text", "ts", F.lit(major).alias("major"), F.col("turn").alias("minor")]
        own = said.select(*cols(F.col("conv_id"), 1))
        prefix = said.where("conv_id % 4 = 0").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).where("k <= 4")
        child = prefix.select(*cols(F.col("conv_id") + FORK_OFFSET, 0))
        rest = said.where("conv_id % 4 = 1").select(*cols(F.col("conv_id") - 1 + FORK_OFFSET, 1))
        replay = said.where("conv_id % 7 = 0").select(*cols(F.col("conv_id"), 9))
        return own.unionByName(child).unionByName(rest).unionByName(replay)

    @cached_property
    def turns(self) -> DataFrame:
        return assign_rounds(self.candidates)

    @cached_property
    def nodes(self) -> DataFrame:
        """The conversation forest: a message's parent is the one before it; a forked child hangs its own messages below the prefix."""
        order = W.partitionBy("session_id").orderBy("round", "message_seq")
        chained = self.turns.withColumn("parent", F.lag("source_uuid").over(order))
        return chained.groupBy(F.col("source_uuid").alias("node_id")).agg(
            F.min_by("parent", F.struct("session_id")).alias("parent_id"), F.min("ts").alias("occurred_at"), F.first("role").alias("role"), F.first("text").alias("text"), F.min("session_id").alias("owner")
        )

    @cached_property
    def forest(self) -> DataFrame:
        """nodes, written once: what walks the forest reads it again and again."""
        return cut(self.nodes, "forest")

    @cached_property
    def observations(self) -> DataFrame:
        """Cursor: a session's last node.  Archive root: its first, for every fifth session."""
        order = F.struct("round", "message_seq")
        ends = self.turns.groupBy("session_id").agg(F.max_by("source_uuid", order).alias("last"), F.min_by("source_uuid", order).alias("first"), F.max("ts").alias("ended_at"))
        kind = lambda node, name, rows: rows.select(F.concat(F.lit("ctx"), F.col("session_id").cast("string")).alias("context"), F.concat(F.lit("src"), (F.col("session_id") % 20).cast("string")).alias("room"), F.lit("chat").alias("source"), F.lit(name).alias("kind"), F.col(node).alias("node_id"), F.col("ended_at").alias("observed_at"))
        both = kind("last", "cursor", ends).unionByName(kind("first", "archive-root", ends.where("session_id % 5 = 0")))
        return both.withColumn("observation_id", canonical_id("", F.col("context"), F.col("kind"), F.col("node_id")))

    @cached_property
    def cards(self) -> DataFrame:
        docs, events = self.documents, self.table("events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("card_ts"))
        d = F.col("doc_id")
        headline = F.split_part("text", F.lit("\n"), F.lit(1))
        return docs.join(events, "doc_id").select(
            F.concat(F.lit("d#"), d.cast("string")).alias("card_id"), "doc_id", F.floor(d / 5).alias("session_id"),
            F.greatest(d % 5, F.lit(1)).alias("turn_start"), (d % 5 + 1).alias("turn_end"), headline.alias("headline"),
            F.when(d % 3 != 0, F.col("text")).otherwise("").alias("share"), F.when((d % 3 == 0) | (d % 5 == 0), F.col("text")).otherwise("").alias("private"),
            F.col("source").alias("room"), F.col("card_ts"),
        )

    @cached_property
    def doc_tokens(self) -> DataFrame:
        """(doc_id, token) once each, of six characters or more."""
        words = self.documents.select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
        return cut(words.where(F.length("token") >= 6), "doc_tokens")  # texts are cut into words once

    @cached_property
    def card_tags(self) -> DataFrame:
        """The five rarest tokens that two documents have."""
        found = rarest(self.doc_tokens, "doc_id", "token", 5)
        return cut(found.select(F.concat(F.lit("d#"), F.col("doc_id").cast("string")).alias("card_id"), F.col("token").alias("tag")), "card_tags")  # ranked once

    @cached_property
    def tag_map(self) -> DataFrame:
        return self.card_tags.select("tag").distinct().withColumn("entity", F.substring("tag", 1, 6))

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings of cards: of the whole card, and of its share alone."""
        share = F.concat(F.slice("embedding", 1, 32), F.array_repeat(F.lit(0.0).cast("float"), 32))
        return self.table("embeddings").join(self.table("documents").select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.concat(F.lit("d#"), F.col("vec_id").cast("string")).alias("card_id"), "vec_id", F.col("embedding").alias("full_vec"), share.alias("share_vec"), "label")

    @cached_property
    def access(self) -> DataFrame:
        n = self.table("documents").agg(F.count("*").alias("n"))
        events = self.table("events").where(F.col("event_type").isin("view", "click"))
        return events.crossJoin(F.broadcast(n)).select(
            F.concat(F.lit("d#"), (F.col("event_id") % F.col("n")).cast("string")).alias("card_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("viewer"),
            F.when(F.col("event_type") == "view", "search").otherwise("other").alias("source"), F.col("ts").alias("read_at"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Primary members of the leaves of the cluster tree."""
        e = self.table("embeddings")
        return e.join(self.table("documents").select(F.col("doc_id").alias("vec_id")), "vec_id").select(F.concat(F.lit("d#"), F.col("vec_id").cast("string")).alias("card_id"), F.concat(F.lit("L"), (F.col("label") % 3).cast("string"), F.lit("."), F.col("label").cast("string")).alias("cluster_id"))

    @cached_property
    def clusters(self) -> DataFrame:
        leaves = self.members.select("cluster_id").distinct().select("cluster_id", F.split_part("cluster_id", F.lit("."), F.lit(1)).alias("parent"), F.lit(2).alias("level"))
        tops = leaves.select(F.col("parent").alias("cluster_id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level")).distinct()
        return tops.unionByName(leaves)

    @cached_property
    def snapshots(self) -> DataFrame:
        """(night, cluster_id, card_id) of two nights."""
        e = self.table("embeddings")
        card, name = F.concat(F.lit("d#"), F.col("vec_id").cast("string")).alias("card_id"), lambda x: F.concat(F.lit("C"), x.cast("string")).alias("cluster_id")
        one = e.where("vec_id % 11 <> 0").select(F.lit("n1").alias("night"), name(F.col("label")), card)
        two = e.select(F.lit("n2").alias("night"), name((F.col("label") + (F.col("vec_id") % 7 == 0).cast("int")) % 10), card)
        return one.unionByName(two)

    @cached_property
    def model_calls(self) -> DataFrame:
        n = self.table("conversations").agg((F.max("conv_id") + 1).alias("n"))
        events = self.table("events").where(F.col("event_type").isin("error", "purchase", "signup"))
        return events.crossJoin(F.broadcast(n)).select("event_id", (F.col("user_id") % F.col("n")).alias("session_id"), F.col("ts").alias("called_at"), (F.col("event_type") != "error").alias("ok"))


TABLES: dict[str, str] = {
    "said": r"""SELECT conv_id, turn, role, text, 'message:' || substr(sha256('conv|' || conv_id || ':' || turn), 1, 32) AS source_uuid,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS ts
      FROM conversations WHERE role IN ('user', 'assistant')""",
    "candidates": r"""SELECT conv_id AS session_id, source_uuid, role, text, ts, 1 AS major, turn AS minor FROM said
      UNION ALL SELECT conv_id + 1000000, source_uuid, role, text, ts, 0, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM said WHERE conv_id % 4 = 0) WHERE k <= 4
      UNION ALL SELECT conv_id - 1 + 1000000, source_uuid, role, text, ts, 1, turn FROM said WHERE conv_id % 4 = 1
      UNION ALL SELECT conv_id, source_uuid, role, text, ts, 9, turn FROM said WHERE conv_id % 7 = 0""",
    "deduped": r"""SELECT session_id, source_uuid, role, text, ts, row_number() OVER (PARTITION BY session_id ORDER BY major, minor, source_uuid) AS ord
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source_uuid ORDER BY major, minor) AS k FROM candidates) WHERE k = 1""",
    "rounded": r"""SELECT *, sum(CASE WHEN role = 'user' OR ord = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ord) AS rnd FROM deduped""",
    "turns": r"""SELECT session_id, source_uuid, role, text, ts, CAST(ord AS BIGINT) AS ord, CAST(rnd AS BIGINT) AS round,
      row_number() OVER (PARTITION BY session_id, rnd ORDER BY ord) AS message_seq FROM rounded""",
    "chained": r"""SELECT *, lag(source_uuid) OVER (PARTITION BY session_id ORDER BY round, message_seq) AS parent FROM turns""",
    "nodes": r"""SELECT source_uuid AS node_id, (list(parent ORDER BY session_id))[1] AS parent_id, min(ts) AS occurred_at, min(role) AS role, min(text) AS text, min(session_id) AS owner
      FROM chained GROUP BY source_uuid""",
    "ends": r"""SELECT session_id, arg_max(source_uuid, ord) AS last, arg_min(source_uuid, ord) AS first, max(ts) AS ended_at FROM turns GROUP BY session_id""",
    "observations": r"""SELECT context, room, source, kind, node_id, observed_at, substr(sha256(context || '|' || kind || '|' || node_id), 1, 32) AS observation_id FROM (
      SELECT 'ctx' || session_id AS context, 'src' || (session_id % 20) AS room, 'chat' AS source, 'cursor' AS kind, last AS node_id, ended_at AS observed_at FROM ends
      UNION ALL SELECT 'ctx' || session_id, 'src' || (session_id % 20), 'chat', 'archive-root', first, ended_at FROM ends WHERE session_id % 5 = 0)""",
    "cards": r"""SELECT 'd#' || d.doc_id AS card_id, d.doc_id, d.doc_id // 5 AS session_id, greatest(d.doc_id % 5, 1) AS turn_start, d.doc_id % 5 + 1 AS turn_end,
      split_part(text, chr(10), 1) AS headline, CASE WHEN d.doc_id % 3 <> 0 THEN text ELSE '' END AS share,
      CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 5 = 0 THEN text ELSE '' END AS private, d.source AS room, e.ts AS card_ts
      FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "doc_tokens": r"""SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents) WHERE length(token) >= 6""",
    "token_df": r"""SELECT token, count(*) AS df FROM doc_tokens GROUP BY token HAVING count(*) >= 2""",
    "card_tags": r"""SELECT 'd#' || doc_id AS card_id, token AS tag FROM (
      SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY df, token) AS k FROM doc_tokens JOIN token_df USING (token)) WHERE k <= 5""",
    "tag_map": r"""SELECT DISTINCT tag, substr(tag, 1, 6) AS entity FROM card_tags""",
    "vectors": r"""SELECT 'd#' || vec_id AS card_id, vec_id, embedding AS full_vec, list_concat(embedding[1:32], list_transform(range(32), lambda x: CAST(0 AS FLOAT))) AS share_vec, label
      FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""",
    "access": r"""SELECT 'd#' || (event_id % (SELECT count(*) FROM documents)) AS card_id, 'src' || (user_id % 20) AS viewer,
      CASE WHEN event_type = 'view' THEN 'search' ELSE 'other' END AS source, ts AS read_at FROM events WHERE event_type IN ('view', 'click')""",
    "members": r"""SELECT 'd#' || vec_id AS card_id, 'L' || (label % 3) || '.' || label AS cluster_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)""",
    "clusters": r"""SELECT DISTINCT split_part(cluster_id, '.', 1) AS cluster_id, CAST(NULL AS VARCHAR) AS parent, 1 AS level FROM members
      UNION ALL SELECT DISTINCT cluster_id, split_part(cluster_id, '.', 1), 2 FROM members""",
    "snapshots": r"""SELECT 'n1' AS night, 'C' || label AS cluster_id, 'd#' || vec_id AS card_id FROM embeddings WHERE vec_id % 11 <> 0
      UNION ALL SELECT 'n2', 'C' || ((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10), 'd#' || vec_id FROM embeddings""",
    "model_calls": r"""SELECT event_id, user_id % (SELECT max(conv_id) + 1 FROM conversations) AS session_id, ts AS called_at, event_type <> 'error' AS ok
      FROM events WHERE event_type IN ('error', 'purchase', 'signup')""",
}


def with_tables(sql: str, **more: str) -> str:
    """sql with the derived tables that it names, and more of its own, as common table expressions."""
    tables = TABLES | more
    needed: dict[str, None] = {}  # each after those that it names

    def need(text: str, *above: str) -> None:
        for name in tables:
            if name not in needed and name not in above and re.search(rf"\b{name}\b", text):
                need(tables[name], name, *above)
                needed[name] = None

    need(sql)
    if not needed:
        return sql
    recursive = "RECURSIVE " if any(tables[n].startswith("RECURSIVE ") for n in needed) else ""
    parts = ", ".join(f"{n} AS ({tables[n].removeprefix('RECURSIVE ')})" for n in needed)
    return f"WITH {recursive}{parts} {sql.strip()}"
