"""Nightly snapshots of the cluster tree: writing and pruning, subtrees of a night, and the report of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.functions.columns import visible
from tidewell.operators import midlayer, tree
from tidewell.store import Texts


def write(spark: SparkSession, path: str, night: str, clusters: DataFrame, members: DataFrame, keep: int = 14) -> list[str]:
    """Puts a night's clusters and members into the store and removes nights beyond the newest `keep` (0 keeps all); gives the removed ones.

    A night that is written again replaces itself and nothing else.
    """
    for name, rows in (("clusters", clusters), ("members", members)):
        rows.withColumn("night", F.lit(night)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("night").parquet(f"{path}/{name}")
    files = Texts(spark, f"{path}/members")
    nights = sorted((n.removeprefix("night=") for n, _ in files.names() if n.startswith("night=")), reverse=True)
    gone = nights[keep:] if keep > 0 else []
    for old in gone:
        for name in ("clusters", "members"):
            Texts(spark, f"{path}/{name}").delete(f"night={old}")
    return gone


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, members) of all nights."""
    return tuple(spark.read.parquet(f"{path}/{name}").withColumn("night", F.col("night").cast("string")) for name in ("clusters", "members"))


def previous_night(nights: DataFrame, night: str) -> DataFrame:
    """One row (night): the last one before a night, or null."""
    return nights.where(F.col("night") < night).agg(F.max("night").alias("night"))


def subtree(clusters: DataFrame) -> DataFrame:
    """(night, cluster_id, member) within each night; clusters: night, cluster_id, parent.  Ids of one night never meet those of another."""
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\n", "night", c))
    closure = tree.subtree(clusters.select(key("cluster_id").alias("cluster_id"), key("parent").alias("parent")))
    part = lambda c, i: F.split_part(c, F.lit("\n"), F.lit(i))
    return closure.select(part("cluster_id", 1).alias("night"), part("cluster_id", 2).alias("cluster_id"), part("member", 2).alias("member"))


def report(clusters: DataFrame, members: DataFrame, cards: DataFrame, access: DataFrame, viewer: str | None, night: str, now: str, timezone: str = "UTC", most_read: int = 8) -> DataFrame:
    """(section, place, key, n_cards, n_new, note) of a night against the one before it.

    community: top clusters by visible cards, n_new those of the last 24 hours, note the day of the last one.  fresh: leaves with visible cards
    since the night before, note where the leaf comes from.  read: the cards that were opened most since then, note by whom.
    reshuffled: how many cards of both nights left their leaf's home without a fresh card in the new leaf.
    """
    spark = cards.sparkSession
    before = previous_night(members.select("night").distinct(), night).first()["night"]
    tonight, seen = clusters.where(F.col("night") == night), cards.where(visible(viewer)).select("card_id", "card_ts")
    closure = subtree(tonight).join(tonight.where("parent IS NULL").select("cluster_id"), "cluster_id", "left_semi")
    now_members = members.where(F.col("night") == night).select("cluster_id", "card_id")
    rows = closure.join(now_members.withColumnRenamed("cluster_id", "member"), "member").join(seen, "card_id").select("cluster_id", "card_id", "card_ts").distinct()
    day = F.col("card_ts") > F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    tops = rows.groupBy(F.col("cluster_id").alias("key")).agg(F.count("*").alias("n_cards"), F.sum(day.cast("long")).alias("n_new"), F.date_format(F.max("card_ts"), "yyyy-MM-dd").alias("note"))
    columns = ["section", "place", "key", "n_cards", "n_new", "note"]

    def placed(df: DataFrame, section: str, *order) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.row_number().over(W.orderBy(*order)).alias("place"), "key", "n_cards", "n_new", "note").select(*columns)  # few rows: clusters, leaves

    out = placed(tops, "community", F.desc("n_cards"), "key")
    if before is None:
        return out
    leaves = midlayer.leaf_clusters(tonight).select("cluster_id")
    new, old = now_members.join(leaves, "cluster_id", "left_semi"), members.where(F.col("night") == before).select("cluster_id", "card_id")
    old = old.join(midlayer.leaf_clusters(clusters.where(F.col("night") == before)).select("cluster_id"), "cluster_id", "left_semi")
    fresh = midlayer.fresh_cards(cards, new, viewer, before, timezone)
    shown = new.join(seen.select("card_id"), "card_id").groupBy("cluster_id").agg(F.count("*").alias("n_cards"))
    notes = midlayer.lineage(midlayer.overlap(old, new)).select(F.col("new_id").alias("cluster_id"), "note")
    lines = fresh.join(shown, "cluster_id").join(notes, "cluster_id", "left").select(F.col("cluster_id").alias("key"), "n_cards", F.col("n_fresh").alias("n_new"), F.coalesce("note", F.lit("new")).alias("note"))
    since = spark.range(1).select(F.convert_timezone(F.lit(timezone), F.lit("UTC"), F.date_add(F.lit(before).cast("date"), 1).cast("timestamp_ntz")).cast("string").alias("s")).first()["s"]
    heat = midlayer.read_heat(access, since).join(seen.select("card_id"), "card_id", "left_semi")
    by = F.array_join(F.transform(F.map_entries("viewers"), lambda e: F.concat(e["key"], F.lit("x"), e["value"].cast("string"))), ", ")
    read_rows = heat.orderBy(F.desc("n_reads"), "card_id").limit(most_read).select(F.col("card_id").alias("key"), F.col("n_reads").alias("n_cards"), F.lit(0).cast("long").alias("n_new"), by.alias("note"))
    quiet = new.join(fresh.select("cluster_id"), "cluster_id", "left_anti")
    home = midlayer.homes(midlayer.overlap(old, new))
    both = old.withColumnRenamed("cluster_id", "old_id").join(quiet.withColumnRenamed("cluster_id", "now_id"), "card_id").join(home, "old_id", "left")
    moved = both.agg(F.count("*").alias("n_cards"), F.coalesce(F.sum((F.col("new_id").isNull() | (F.col("new_id") != F.col("now_id"))).cast("long")), F.lit(0)).cast("long").alias("n_new"))
    moved = moved.select(F.lit("cards").alias("key"), "n_cards", "n_new", F.lit("").alias("note"))
    return out.unionByName(placed(lines, "fresh", F.desc("n_new"), "key")).unionByName(placed(read_rows, "read", F.desc("n_cards"), "key")).unionByName(placed(moved, "reshuffled", "key"))


TITLES = {"community": "Communities (cards, new in 24 hours, last active):", "fresh": "Lines with new cards:", "read": "Opened most:", "reshuffled": "Moved without new cards:"}


def render(rows: list[dict], night: str, before: str | None) -> str:
    """The report's rows as text."""
    out, section = [f"== tree of {night} " + (f"(against {before}) ==" if before else "(first night) ==")], None
    for row in sorted(rows, key=lambda r: (list(TITLES).index(r["section"]), r["place"])):
        if row["section"] != section:
            section = row["section"]
            out += ["", TITLES[section]]
        out.append(f"  {row['key']}  {row['n_cards']}  +{row['n_new']}  {row['note']}".rstrip())
    return "\n".join(out) + "\n"
