"""Incremental ingest: a file stream of journals, turns kept in a versioned table, a revision that counts real changes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.rounds import assign_rounds
from tidewell.sources import journal
from tidewell.store import Texts, cut

TURN_KEYS = ["session_id", "source_uuid"]
KEYS = [*TURN_KEYS, "major", "minor", "file"]


def changes(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row (inserted, updated, deleted): nulls compare as equal, so a replay counts nothing."""
    a = old.select(*keys, F.struct(*fields).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.struct(*fields).alias("_new"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    one = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0)).cast("long")
    return both.agg(
        one(F.col("_a").isNull()).alias("inserted"), one(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("updated"), one(F.col("_b").isNull()).alias("deleted")
    )


class TurnStore:
    """Candidates as they came (first one wins) and the turns that follow from them, in buckets by session.

    A manifest names the folder of each bucket and holds the revision.  A batch writes the buckets that it touches, beside the old
    ones, and then replaces the manifest: one swap, so that a crash leaves turns, candidates and revision as they were, and a
    replay counts what it changes once.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self._files = spark, path.rstrip("/"), buckets, Texts(spark, path)

    def _manifest(self) -> dict:
        found = self._files.get("_MANIFEST")
        return json.loads(found) if found else {"revision": 0, "buckets": {}}

    def revision(self) -> int:
        return self._manifest()["revision"]

    def _read(self, part: str, buckets: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in self._manifest()["buckets"].items() if buckets is None or int(b) in buckets]
        paths = [f"{self.path}/{version}/{part}/bucket={b}" for version, b in (f.rsplit("-", 1) for f in folders)]
        return self.spark.read.parquet(*paths) if paths else None

    def candidates(self) -> DataFrame | None:
        return self._read("candidates")

    def turns(self) -> DataFrame | None:
        return self._read("turns")

    def add(self, rows: DataFrame) -> int:
        """Adds candidates, numbers the sessions of the touched buckets anew and gives the revision, which grows by the turns that changed.

        Late and out-of-order rows are never dropped: their sessions are derived again from all candidates.
        """
        bucket = F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(self.buckets)).cast("int")
        file = F.coalesce("file", F.lit("")) if "file" in rows.columns else F.lit("")
        new = cut(rows.withColumn("file", file).dropDuplicates(KEYS), "batch")  # a message that several files hold stays while one of them does
        touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return self.revision()
        return self._rewrite(new, touched, bucket, self._manifest())

    def reconcile(self, keep: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites all buckets with the candidates that `keep` leaves of them, such as those whose file is still there."""
        manifest = self._manifest()
        bucket = F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(self.buckets)).cast("int")
        every = self._read("candidates")
        return manifest["revision"] if every is None else self._rewrite(keep(every), [int(b) for b in manifest["buckets"]], bucket, manifest, fresh=True)

    def _rewrite(self, rows: DataFrame, touched: list[int], bucket: Column, manifest: dict, fresh: bool = False) -> int:
        old, before = None if fresh else self._read("candidates", touched), self._read("turns", touched)
        every = rows if old is None else old.unionByName(rows.join(old, KEYS, "left_anti"))
        version = f"v-{uuid.uuid4().hex}"
        every.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{version}/candidates")
        written = self.spark.read.schema(every.schema).parquet(f"{self.path}/{version}/candidates")
        turns = assign_rounds(written)
        turns.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{version}/turns")
        after = self.spark.read.schema(turns.schema).parquet(f"{self.path}/{version}/turns")
        found = changes(after.limit(0) if before is None else before, after, TURN_KEYS, ["role", "text", "round", "message_seq"]).first()
        made = {r["b"] for r in written.select(bucket.alias("b")).distinct().collect()}
        for b in touched:  # a bucket is a folder of its own below the version that wrote it last
            manifest["buckets"].pop(str(b), None)
            if b in made:
                manifest["buckets"][str(b)] = f"{version}-{b}"
        manifest["revision"] += sum(found)
        self._files.put("_MANIFEST", json.dumps(manifest, sort_keys=True))
        return manifest["revision"]

    def vacuum(self) -> int:
        """Removes versions that no bucket names."""
        used = {f.rsplit("-", 1)[0] for f in self._manifest()["buckets"].values()}
        gone = [name for name, _ in self._files.names() if name.startswith("v-") and name not in used]
        for name in gone:
            self._files.delete(name)
        return len(gone)


def journal_candidates(lines: DataFrame) -> DataFrame:
    """Turn candidates of journal lines (path, line_no, value)."""
    said = journal.messages(journal.parse_lines(lines))
    return said.select(
        F.xxhash64("sessionId").alias("session_id"), F.col("uuid").alias("source_uuid"), "role", "text", F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("major"), F.col("line_no").alias("minor"), F.col("path").alias("file")
    )


def vanished(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """The candidates whose file is still listed; those without a file stay.  candidates: file.  listing: file."""
    there = listing.select(F.col("file").alias("_file")).distinct()
    return candidates.where("file <> ''").join(there, F.col("file") == F.col("_file"), "left_semi").unionByName(candidates.where("file IS NULL OR file = ''"))


def stale_turns(stored: DataFrame, eligible: DataFrame) -> DataFrame:
    """Stored turns (session_id, source_uuid) that no eligible path holds any more."""
    return stored.join(eligible, TURN_KEYS, "left_anti")


def watch(spark: SparkSession, folder: str, store: TurnStore, checkpoint: str, *, once: bool = True, interval: str = "5 seconds") -> StreamingQuery:
    """Streams new journal files of a folder into the store; the checkpoint remembers what was read, each batch may be replayed."""
    files = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.jsonl").load(folder)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")).where(F.col("value").rlike(r"\S"))

    def batch(frame: DataFrame, _: int) -> None:
        store.add(journal_candidates(frame))

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


class Poller:
    """Does a piece of work when a revision has grown; the last revision that was seen to its end is kept in a file.

    The first poll, and one that finds a smaller revision than the kept one (the store was replaced), only set the baseline.  Work that
    fails leaves the cursor, so the next poll does it again.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, revision: Callable[[], int], work: Callable[[int, int], None]):
        self._files, self.name, self.revision, self.work = Texts(spark, path), name, revision, work

    def poll(self) -> bool:
        kept, now = self._files.get(self.name), self.revision()
        if kept is None or now < int(kept):
            self._files.put(self.name, str(now))
            return False
        if now == int(kept):
            return False
        self.work(int(kept), now)
        self._files.put(self.name, str(now))
        return True


class WriterLock:
    """One writer at a time: a file that is made only if it isn't there; waiting for it ends after `tries` pauses with an error."""

    def __init__(self, spark: SparkSession, path: str, tries: int = 600, pause: float = 0.1):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_LOCK")
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.tries, self.pause = tries, pause

    def __enter__(self) -> WriterLock:
        for _ in range(self.tries):
            try:
                self._fs.create(self._path, False).close()
                return self
            except Exception:  # it is there: another writer's
                if not self._fs.exists(self._path):
                    raise
                time.sleep(self.pause)
        raise TimeoutError(f"{self._path} is held")

    def __exit__(self, *_: object) -> None:
        self._fs.delete(self._path, False)
