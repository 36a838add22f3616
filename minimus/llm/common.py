"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Words of the texts: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one numpy step handles at a time.
STEP_BYTES = 768 << 10

#: Bytes (as written) up to which a measured side is broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the
    lineage, so that a lost executor re-reads files instead of redoing the job."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(staged: DataFrame) -> int:
    """Bytes in the folders behind a staged table."""
    jvm = staged.sparkSession._jvm
    conf = staged.sparkSession._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)


def small_side(staged: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a staged side if its measured size allows; otherwise Spark joins
    it by a shuffle. The rows are the same either way."""
    return F.broadcast(staged) if written_bytes(staged) <= limit else staged


def text_parts(col: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string or
    binary column, about ``step`` bytes at a time (a longer text comes alone).
    Nulls count as empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def ints(col: pa.Array) -> np.ndarray:
    """A non-null integer column as int64."""
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)


#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 6 << 20


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers and batches bounded
    in bytes (by default only their rows are bounded, and a row may hold a long text)."""
    spark = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def run(batches):
        yield from fn(batches)
        release_memory()

    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the system: a worker waits for its next task beside
    others, and the allocators would keep what this one had at its peak."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)
