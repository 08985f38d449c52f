"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node of its component.

    Each round points every node to the least of itself and its neighbours, follows the pointers twice, and then
    replaces the edges' ends by their roots: edges inside a component vanish, so each round's graph is a fraction of the one
    before.  Rounds are written to the shared folder; nothing is collected but whether edges are left.  A node
    with very many edges is folded before each shuffle.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    graph = written(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = graph.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(graph.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hooked = written(spark, ends.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("up")), "hooked")
        jump = hooked.select(F.col("node").alias("up"), F.col("up").alias("next"))
        once = hooked.join(jump, "up").select("node", F.col("next").alias("up"))
        moved = written(spark, once.join(jump, "up").select("node", F.col("next").alias("root")), "moved")
        if labels is None:
            labels = moved
        else:  # a root that has no edge any more stays
            onward = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(spark, labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        left, right = moved.select(F.col("node").alias("a"), F.col("root").alias("ra")), moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = graph.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        graph = written(spark, rest.distinct(), "edges")
        if graph.isEmpty():
            return labels
