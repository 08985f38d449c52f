"""Forests of conversation nodes: roots, depth, cycles, ancestor closures, branches and their turns.

Chains are long, so nothing walks them a step a round: labels are doubled (a node's pointer jumps to its pointer's
pointer), which takes log2(depth) rounds.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.operators.rounds import completed_rounds
from tidewell.store import cut


def node_root(nodes: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node_id, root, depth, cyclic) from (node_id, parent_id); a parent that isn't there makes a root.

    cyclic: no root was reached; after as many rounds as double past the number of nodes that is proof of a cycle.
    """
    known = nodes.select(F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    state = nodes.select("node_id", "parent_id").join(known, "parent_id", "left").select("node_id", F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("node_id")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"))
    state = cut(state, "pointers")
    left, rounds = state.count(), 0
    while rounds < most_rounds:
        above = state.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = cut(state.join(above, "up").select("node_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("more")), "pointers")
        active = moved.where("more > 0").limit(1).count()
        state, rounds = moved.drop("more"), rounds + 1
        if not active or 2**rounds > left:
            break
    ends = state.where("depth = 0").select(F.col("node_id").alias("up"), F.lit(True).alias("is_root"))
    return state.join(ends, "up", "left").select("node_id", F.when(F.col("is_root"), F.col("up")).alias("root"), F.when(F.col("is_root"), F.col("depth")).alias("depth"), F.col("is_root").isNull().alias("cyclic"))


def ancestors(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, node_id, distance): every node on the path from each tip (column tip) to its root, itself included."""
    up = nodes.where("parent_id IS NOT NULL").select("node_id", F.col("parent_id").alias("up"))
    up = cut(up.join(nodes.select(F.col("node_id").alias("up")), "up", "left_semi"), "up")
    paths = tips.select("tip", F.col("tip").alias("node_id"), F.lit(0).cast("long").alias("distance"))
    paths, step = cut(paths, "paths"), 1
    while True:
        longer = paths.join(up, "node_id").select("tip", F.col("up").alias("node_id"), (F.col("distance") + step).alias("distance"))
        longer = cut(longer, "longer")
        if longer.isEmpty():
            return paths
        paths = cut(paths.unionByName(longer), "paths")
        jump = up.select(F.col("node_id").alias("up"), F.col("up").alias("next"))
        up, step = cut(up.join(jump, "up").select("node_id", F.col("next").alias("up")), "up"), 2 * step


def path_summary(nodes: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, path_length, first_user_text): the text of the user nearest to the root that isn't blank."""
    path = ancestors(nodes, tips).join(nodes.select("node_id", "role", "text"), "node_id")
    said = (F.col("role") == "user") & F.col("text").rlike(r"\S")
    return path.groupBy("tip").agg(F.count("*").alias("path_length"), F.max_by(F.when(said, F.col("text")), F.when(said, F.col("distance"))).alias("first_user_text"))


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Nodes that name a parent which isn't there."""
    named = nodes.where("parent_id IS NOT NULL")
    return named.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_anti").select("node_id", "parent_id")


def branches(nodes: DataFrame) -> DataFrame:
    """(node_id, branch): of siblings the first to arrive, by (batch, occurred_at, node_id), stays in its parent's branch, every other opens its own.

    batch: the number of the load that brought a node, where nodes has it.  A branch is named by its first node.
    """
    order = [*(["batch"] if "batch" in nodes.columns else []), "occurred_at", "node_id"]
    first = F.row_number().over(W.partitionBy("parent_id").orderBy(*order)) == 1
    inherit = nodes.withColumn("parent_id", F.when(F.col("parent_id").isNotNull() & first, F.col("parent_id")))
    return node_root(inherit).select("node_id", F.col("root").alias("branch"))


def branch_paths(nodes: DataFrame, of_branch: DataFrame) -> DataFrame:
    """(branch, pos, node_id, role, is_context): each branch's path from the root to its tip."""
    depth = node_root(nodes).select("node_id", "depth")
    tips = of_branch.join(depth, "node_id").groupBy("branch").agg(F.max_by("node_id", "depth").alias("tip"))
    path = ancestors(nodes, tips).join(tips, "tip").join(depth, "node_id").join(nodes.select("node_id", "role"), "node_id")
    owner = of_branch.select("node_id", F.col("branch").alias("owner"))
    return path.join(owner, "node_id").select("branch", F.col("depth").alias("pos"), "node_id", "role", (F.col("owner") != F.col("branch")).alias("is_context"))


def branch_turns(paths: DataFrame) -> DataFrame:
    """(branch, node_id, round, message_seq, is_context) of the completed rounds of each path."""
    rows = completed_rounds(paths.where(F.col("role").isin("user", "assistant")), "branch")
    rounds = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(W.partitionBy("branch").orderBy("pos"))
    numbered = rows.withColumn("round", rounds)
    return numbered.select("branch", "node_id", "round", F.row_number().over(W.partitionBy("branch", "round").orderBy("pos")).alias("message_seq"), "is_context")


def topological(nodes: DataFrame) -> DataFrame:
    """(node_id, pos): parents before children, then by (occurred_at, node_id); places are counted depth by depth, so no window spans the table."""
    placed = nodes.join(node_root(nodes).select("node_id", "depth"), "node_id")
    sizes = placed.groupBy("depth").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a depth
    rank = F.row_number().over(W.partitionBy("depth").orderBy(F.col("occurred_at").asc_nulls_first(), "node_id"))
    return placed.withColumn("rank", rank).join(starts.select("depth", "start"), "depth").select("node_id", (F.col("start") + F.col("rank") - 1).cast("long").alias("pos"))


def numbered_clusters(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster_id, name, parent_name): names c0001, c0002, ... in pre-order, siblings by size, greatest first, then by id.

    clusters: cluster_id, parent.  sizes: cluster_id, size.  A cluster's key is the path of (size, id) from its root, whose order is the pre-order.
    """
    sized = clusters.join(sizes, "cluster_id", "left").select("cluster_id", "parent", F.struct((-F.coalesce("size", F.lit(0))).alias("less"), "cluster_id").alias("own"))
    closure = ancestors(sized.select(F.col("cluster_id").alias("node_id"), F.col("parent").alias("parent_id")), sized.select(F.col("cluster_id").alias("tip")))
    keyed = closure.join(sized.select(F.col("cluster_id").alias("node_id"), "own"), "node_id").groupBy(F.col("tip").alias("cluster_id"))
    keys = keyed.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "own"))), lambda x: x["own"]).alias("key"))
    named = keys.select("cluster_id", F.format_string("c%04d", F.row_number().over(W.orderBy("key"))).alias("name"))  # a row a cluster
    above = named.select(F.col("cluster_id").alias("parent"), F.col("name").alias("parent_name"))
    return clusters.select("cluster_id", "parent").join(named, "cluster_id").join(above, "parent", "left").select("cluster_id", "name", "parent_name")


def children(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """(parent, cluster_id, size, k): children of each cluster, and the roots below null, by size, greatest first."""
    joined = clusters.join(sizes, "cluster_id")
    return joined.select("parent", "cluster_id", "size", F.row_number().over(W.partitionBy("parent").orderBy(F.desc("size"), "cluster_id")).alias("k"))


def subtree(clusters: DataFrame) -> DataFrame:
    """(cluster_id, member): every cluster with all clusters below it, itself included; from (cluster_id, parent)."""
    return ancestors(clusters.select(F.col("cluster_id").alias("node_id"), F.col("parent").alias("parent_id")), clusters.select(F.col("cluster_id").alias("tip"))).select(F.col("node_id").alias("cluster_id"), F.col("tip").alias("member"))


def latest_observation(observations: DataFrame) -> DataFrame:
    """The newest of each (room, source, context, kind), for archive roots also of each node."""
    key = F.when(F.col("kind") == "archive-root", F.col("node_id"))
    w = W.partitionBy("room", "source", "context", "kind", key).orderBy(F.desc("observed_at"), F.desc("observation_id"))
    return observations.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def catalog(observations: DataFrame) -> DataFrame:
    """One row a (room, source, context): the newest, a cursor before an archive root of the same time."""
    w = W.partitionBy("room", "source", "context").orderBy(F.desc("observed_at"), F.when(F.col("kind") == "cursor", 0).otherwise(1), F.desc("observation_id"))
    return latest_observation(observations).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
