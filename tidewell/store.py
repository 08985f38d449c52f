"""The shared folder, tables that cut a lineage, and versioned tables with an atomic pointer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_CURRENT"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or where that is unset on a local master (tests) one of our own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


#: A scan of fewer bytes is dealt out to all cores before work on its texts; a larger one has splits enough.
SMALL_SCAN = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan (by its files' size) in as many partitions as there are cores: a file of one row group is one task's work otherwise."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_SCAN else df


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """df written to the shared folder and read back, so that loops don't grow the plan and a lost executor loses no round."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table of short ids that are counted and then broadcast at most.
MAX_HELD = 500_000


def held(df: DataFrame, most: int = MAX_HELD) -> DataFrame:
    """df, marked for a broadcast if it has no more than `most` rows; beyond that a join with it shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Texts:
    """Small text files of a shared folder, replaced by a rename, so that a reader sees the old or the new one and never a part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        self._utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8

    def get(self, name: str) -> str | None:
        file = self._path(f"{self.path}/{name}")
        if not self._fs.exists(file):
            return None
        stream = self._fs.open(file)
        try:
            return self._io.toString(stream, self._utf8)
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        temp, final = self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.path}/{name}")
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final):
            jvm = self.spark.sparkContext._jvm
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
            options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(final), options)
        else:
            self._fs.rename(temp, final)

    def names(self) -> list[tuple[str, int]]:
        """(name, time of change) of what lies in the folder, newest first."""
        folder = self._path(self.path)
        found = [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((f for f in found if not f[0].startswith(".")), key=lambda f: (-f[1], f[0]))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)


class VersionedTable:
    """Versions of a table under one folder; readers follow a pointer file that is replaced by a rename.

    A crash between write and swap leaves the old version current and an orphan folder that `vacuum` removes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), Texts(spark, path)

    def version(self) -> str | None:
        found = self._files.get(POINTER)
        return found.strip() if found else None

    def read(self) -> DataFrame | None:
        version = self.version()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def stage(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Writes a version without making it current."""
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.path}/{version}")
        return version

    def swap(self, version: str) -> None:
        """Makes a staged version current."""
        self._files.put(POINTER, version)

    def write(self, df: DataFrame) -> None:
        self.swap(self.stage(df))

    def upsert(self, rows: DataFrame, keys: list[str], keep: str = "first") -> None:
        """keep: `first` leaves present rows as they are (insert or ignore), `last` replaces them by key."""
        old = self.read()
        if old is None:
            self.write(rows.dropDuplicates(keys))
        elif keep == "first":
            self.write(old.unionByName(rows.dropDuplicates(keys).join(old, keys, "left_anti")))
        else:
            self.write(old.join(rows, keys, "left_anti").unionByName(rows.dropDuplicates(keys)))

    def versions(self) -> list[str]:
        """All versions, newest first by the time at which they were written."""
        return [name for name, _ in self._files.names() if name.startswith("v-")]

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the current one and the newest others, `keep` in all: the rest are backups."""
        current = self.version()
        kept = [current, *[v for v in self.versions() if v != current][: max(0, keep - 1)]]
        gone = [v for v in self.versions() if v not in kept]
        for name in gone:
            self._files.delete(name)
        return len(gone)

    def restore(self, version: str) -> None:
        """Makes a kept version current again."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self.swap(version)
