"""What the operators of this package share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Rows of one output batch of a Python operator; bounds a worker's memory, not its input.
OUT_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Where the setting is missing, a local session takes a folder
    of its one machine; on a cluster, whose machines share no such folder, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "/tmp/checkpoints"
    return f"{base.rstrip('/')}/cloakframe-{uuid.uuid4().hex}"


def written(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs no rerun.

    At most ``tasks`` tasks write it, if given, so that few rows come in few files: each file made costs a process where
    Hadoop has no native library. The files are deleted by ``release`` or else when the session's file system is closed.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    (df.coalesce(tasks) if tasks else df).write.parquet(path)
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if (own := _OWN.get()) is not None:
        own.append(path)
    return out


#: Folders written since ``written_alone`` began, of this thread's innermost call.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def written_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The written table of what ``make`` returns; all that was written on the way to it by this call is deleted."""
    mark = _OWN.set([])
    try:
        out = written(make())
        for path in _OWN.get():
            if path != out._written_to:
                _delete(out.sparkSession, path)
    finally:
        _OWN.reset(mark)
    if (outer := _OWN.get()) is not None:
        outer.append(out._written_to)
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where, system = _place(spark, path)
    system.delete(where, True)


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` of these rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType, size: int = OUT_ROWS) -> DataFrame:
    """``make`` over the rows of each partition, in Arrow batches: tuples of ``columns`` in, tuples of ``schema`` out.

    Input batches are read in slices, so a worker holds one Arrow batch and ``size`` rows of output.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        return batched(make(rows()), out, size)

    return df.select(*columns).mapInArrow(run, schema)


def training_rows(doc_id: str, parts: int) -> F.Column:
    """True where crc32 of the id as text leaves a remainder other than 0."""
    return (F.crc32(F.col(doc_id).cast("string")) % parts) != 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small file, which one task would read, is dealt out to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
