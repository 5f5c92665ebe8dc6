"""What the operators of this subpackage share: sessions, shared storage and Arrow batches.

Hot-path Python runs on Arrow batches (``mapInArrow``); a batch holds few rows, as single texts may be very long.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import sound

#: Rows of an Arrow batch: bounds a Python worker's memory by so many texts.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches, and let Python workers give memory back when they free it. Both hold for the whole session:
    Spark has no such setting for a single plan."""
    sound(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    env.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)})
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all tasks run in the
    driver's process (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Folders of tables written within ``scratch``, innermost last.
_scratch: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    The table outlives any executor. It goes with ``dropped`` or ``scratch``, else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    leaving(spark, path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def leaving(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/quern-" in path:
            _deleted(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are deleted at the end: what is still needed then must lie elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _deleted(spark, path)


def calm(f: Callable) -> Callable:
    """``f``, of one or two tables, without cyclic garbage collection, which would walk its many lists again and again,
    and with the memory that it frees given back to the system: Python workers stay and wait beside the next stage's."""

    def run(*tables: pa.Table) -> pa.Table:
        gc.disable()
        try:
            return f(*tables)
        finally:
            gc.enable()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    # Spark counts the arguments
    return (lambda one: run(one)) if f.__code__.co_argcount == 1 else (lambda one, other: run(one, other))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``f`` on each Arrow batch; None yields no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small batches of numbers joined to larger ones."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def texts_of(column: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def bytes_of(column: pa.Array):
    """Texts as one array of UTF-8 bytes and the offsets of each; null is empty."""
    import numpy as np

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def free_name(columns: list[str], wanted: str) -> str:
    """A name like ``wanted`` that none of these columns has; Spark tells no case apart."""
    taken, n = {c.lower() for c in columns}, 0
    while (name := f"{wanted}{n or ''}").lower() in taken:
        n += 1
    return name


def text_column(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
