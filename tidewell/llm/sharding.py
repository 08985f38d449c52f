"""Sharding by fixed virtual slots (DataFrame functions only).

Records are hashed into N_SLOTS virtual slots, bytes are summed for each slot, and a versioned
map from slot to shard is stored, each version in a folder of its own that a second writer can't take.  Version 1 deals the
slots in turn, before any size is known; `rebalance` edits a stored version for new sizes or another shard count
and moves only slots that must move, largest first to the lightest shard.  The query stores version 1, edits it by the slots'
bytes and places the records by version 2.  `assign_slots` makes a first map from sizes where there are some.  A record's slot never changes, so that only whole
slots travel.  The law that holds is `bytes`: shard sizes are near equal.

Only (hash, size) pairs are aggregated, before the shuffle; the map has N_SLOTS rows whatever
the input, which is the proven bound behind its broadcast.  The hash takes id and text, so
neither a hot id, a null id nor a hot source gathers in a slot; copies of a text with ids of their own are so dealt to many
slots, as a group of copies may hold more bytes than a shard.  A record's place in its shard is
the rows of the shard's earlier slots plus its rank in its own slot: no window spans a shard.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id is hashed as such;
equal rows share a slot and take neighbouring places; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewell.llm.common import read, shared_dir, unused

N_SLOTS = 4096
N_SHARDS = 16


def slot_of(key: list[Column], n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record, from a 64-bit hash of its key columns."""
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_stats(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(slot, bytes, rows) for every slot, empty ones too; records: virtual_slot, size."""
    seen = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    zero = F.lit(0).cast("long")
    return every.join(seen, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("rows", zero).alias("rows"))


def assign_slots(stats: DataFrame, n_shards: int = N_SHARDS, version: int = 1) -> DataFrame:
    """A first map (version, n_shards, virtual_slot, shard, bytes, rows): largest slots first, each to the lightest shard."""
    ordered = stats.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "rows"))).alias("slots"))
    folded = ordered.withColumn("placed", _place(F.col("slots"), F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda _: F.lit(0).cast("long"))))
    return _as_map(folded, n_shards, version)


def _place(slots: Column, loads: Column) -> Column:
    """The shard of each slot, in order; loads: bytes that each shard has already."""
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))

    def step(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["neg"]).otherwise(x)).alias("loads"),
            F.concat(state["shards"], F.array(to)).alias("shards"),
        )

    return F.aggregate(slots, start, step, lambda state: state["shards"])


def _as_map(folded: DataFrame, n_shards: int, version: int) -> DataFrame:
    pairs = folded.select(F.explode(F.arrays_zip("slots", F.col("placed").alias("shard"))).alias("p"))
    slot = F.col("p")["slots"]
    return pairs.select(
        F.lit(version).alias("version"), F.lit(n_shards).alias("n_shards"), slot["virtual_slot"].alias("virtual_slot"),
        F.col("p")["shard"].alias("shard"), (-slot["neg"]).alias("bytes"), slot["rows"].alias("rows"),
    )


def rebalance(current: DataFrame, stats: DataFrame, n_shards: int, tolerance: float = 0.02) -> DataFrame:
    """The map's next version, for new slot sizes or another shard count.

    A slot stays where it is while its shard is below (1 + tolerance) times the mean; slots beyond
    that, and those of shards that are gone, go largest first to the lightest shard.
    """
    version = current.agg(F.max("version") + 1).alias("next")
    joined = stats.join(F.broadcast(current.select("virtual_slot", F.col("shard").alias("old"))), "virtual_slot", "left")
    mean = joined.agg((F.sum("bytes") * (1.0 + tolerance) / n_shards).alias("most"))
    run = F.sum("bytes").over(W.partitionBy("old").orderBy(F.desc("bytes"), "virtual_slot"))  # windows over N_SLOTS rows in all
    marked = joined.withColumn("run", run).crossJoin(F.broadcast(mean)).withColumn("stays", F.coalesce((F.col("old") < n_shards) & (F.col("run") <= F.col("most")), F.lit(False)))
    kept = marked.where("stays").select("virtual_slot", "bytes", "rows", F.col("old").alias("shard"))
    every = stats.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(kept.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").groupBy().agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load")))), lambda x: x["load"]).alias("loads")
    )
    slots = marked.where("NOT stays").groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "virtual_slot", "rows"))).alias("slots"))
    moved = _as_map(slots.crossJoin(loads).withColumn("placed", _place(F.col("slots"), F.col("loads"))), n_shards, 0)
    both = kept.select("virtual_slot", "shard", "bytes", "rows").unionByName(moved.select("virtual_slot", "shard", "bytes", "rows"))
    return both.crossJoin(F.broadcast(version.toDF("version"))).select("version", F.lit(n_shards).alias("n_shards"), "virtual_slot", "shard", "bytes", "rows")


def even_map(stats: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 1 of a map: the slots in turn."""
    return stats.select(F.lit(1).alias("version"), F.lit(n_shards).alias("n_shards"), "virtual_slot", F.pmod("virtual_slot", F.lit(n_shards)).cast("int").alias("shard"), "bytes", "rows")


def store_map(slot_map: DataFrame, path: str, version: int) -> DataFrame:
    """Writes a version beside the others and reads it back; fails if that version is there, so two writers can't both have made it."""
    slot_map.drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, or the newest."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def place(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """records (with virtual_slot) with shard, slot (place in the shard, gapless from 0) and map_version."""
    first = F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1))  # over N_SLOTS rows in all
    starts = slot_map.select("virtual_slot", "shard", F.col("version").alias("map_version"), F.coalesce(first, F.lit(0).cast("long")).alias("_first"))
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    place_, start = unused(records, "rank"), unused(records, "first")
    joined = records.withColumn(place_, rank).join(F.broadcast(starts.withColumnRenamed("_first", start)), "virtual_slot")
    return joined.withColumn("slot", F.col(start) + F.col(place_)).drop(start, place_)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    records = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of([F.col("doc_id"), text]).alias("virtual_slot")
    )
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}/slot_map"
    stats = slot_stats(records)
    first = store_map(even_map(stats), path, 1)
    second = store_map(rebalance(first, first.select("virtual_slot", "bytes", "rows"), N_SHARDS, 0.0), path, 2)
    placed = place(records, second, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


QUERIES = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
