"""What the operators of this package share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir.

    Only where that is unset on a local master (tests in one process) a temporary folder is made and set; a cluster
    without the setting is refused, as its machines share no such folder.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(spark: SparkSession, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back; `released` removes what it wrote."""
    path = f"{shared_dir(spark)}/tidewell/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path, compression=codec)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The folders that `written` made in this process and that are still there.
_MADE: list[str] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables written inside the block; use it around an action whose result is stored elsewhere."""
    start = len(_MADE)
    try:
        yield
    finally:
        release(spark, _MADE[start:])


def release(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _MADE.remove(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{'_' * i}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def with_columns(df: DataFrame, fields: list[T.StructField], fn: Callable[[pa.RecordBatch], dict[str, Iterable]]) -> DataFrame:
    """df with further columns made batch by batch.  A column of df with a clashing name is replaced.

    fn gets an Arrow batch with all columns of df and returns the values of each field.
    """
    names = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    kinds = {f.name: _arrow(f.dataType) for f in fields}
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = fn(batch)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept_names]
            columns += [v if isinstance(v := made[n], pa.Array) else pa.array(v, type=kind) for n, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, *kinds])

    return df.mapInArrow(run, T.StructType([*kept, *fields]))


#: Rows of a piece of an Arrow batch.
PIECE = 1_000


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that what is made of them is small; free memory goes back to the machine before and after.

    Workers are reused by all stages of a session, and what one stage freed but kept would count against the next one.
    """
    trim()
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only this machine's C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def field(name: str, kind: str) -> T.StructField:
    """A nullable field from a simple type name."""
    return T.StructField(name, T._parse_datatype_string(kind) if kind not in SIMPLE else SIMPLE[kind], True)


SIMPLE = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}
