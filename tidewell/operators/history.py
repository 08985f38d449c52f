"""Reading a conversation's history: filters, the page of one context with its paths, and its document."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import tree

FORMAT = "history-v1"


def filtered(observations: DataFrame, room: str | None = None, source: str | None = None, context: str | None = None, kind: str | None = None) -> DataFrame:
    """Observations of a room, a source, a context, a kind; what isn't given isn't asked."""
    for name, value in (("room", room), ("source", source), ("context", context), ("kind", kind)):
        if value:
            observations = observations.where(F.col(name) == value)
    return observations


def component_nodes(nodes: DataFrame, roots: DataFrame, observations: DataFrame) -> DataFrame:
    """All nodes of the components in which the observations' nodes lie; roots: node_id, root."""
    wanted = observations.select("node_id").distinct().join(roots, "node_id").select("root").distinct()
    return nodes.join(roots.join(wanted, "root", "left_semi").select("node_id", "root"), "node_id")


def cursor_paths(nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """(observation_id, path): the node ids from the root to each cursor's node; other kinds have an empty path."""
    tips = observations.where("kind = 'cursor'").select(F.col("node_id").alias("tip")).distinct()
    walked = tree.ancestors(nodes, tips.join(nodes.select(F.col("node_id").alias("tip")), "tip", "left_semi"))
    paths = walked.groupBy("tip").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "node_id"))).alias("p")).select(F.col("tip").alias("node_id"), F.transform("p", lambda x: x["node_id"]).alias("path"))
    joined = observations.select("observation_id", "node_id", "kind").join(paths, "node_id", "left")
    empty = F.array().cast("array<string>")
    return joined.select("observation_id", F.when(F.col("kind") == "cursor", F.coalesce("path", empty)).otherwise(empty).alias("path"))


def render(nodes: DataFrame, roots: DataFrame, observations: DataFrame, room: str, source: str | None = None, context: str | None = None, most: int = 10_000) -> dict[str, Any]:
    """The document of a context's history, or of a room's: roots, nodes in order of time, observations with their paths.

    It is a page for a reader, so more than `most` nodes are refused; ask for one context then.
    """
    seen = tree.latest_observation(filtered(observations, room, source, context))
    rows = component_nodes(nodes, roots, seen).orderBy(F.col("occurred_at").asc_nulls_first(), "node_id").limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} nodes")
    found = [json.loads(r) for r in rows]
    shown = seen.join(cursor_paths(nodes, seen), "observation_id").orderBy("source", "context", "kind", "observation_id")
    return {"format": FORMAT, "room": room, "source": source, "roots": [n["node_id"] for n in found if n["node_id"] == n["root"]], "nodes": found, "observations": [json.loads(r) for r in shown.toJSON().collect()]}


def visible_in_order(ids: DataFrame, visible: DataFrame) -> DataFrame:
    """ids (card_id, pos) that are among the visible cards, in their own order with gapless places."""
    from pyspark.sql.window import Window as W

    kept = ids.join(visible.select("card_id").distinct(), "card_id", "left_semi")
    group = [c for c in ids.columns if c not in ("card_id", "pos")]
    return kept.withColumn("pos", (F.row_number().over(W.partitionBy(*group).orderBy("pos", "card_id")) - 1).cast("long"))
