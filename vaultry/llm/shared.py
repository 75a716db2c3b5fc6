"""Helpers of the subpackage: tables, the shared work folder, bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Text bytes that a task holds as tokens at a time; one longer text is taken alone.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; cuts the lineage."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def put_file(spark: SparkSession, uri: str, data: bytes) -> None:
    """Write one file through the file system that Spark has for ``uri``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for start in range(0, len(data), 1 << 20):
            stream.write(data[start : start + (1 << 20)])
    finally:
        stream.close()


def crc_mod5(column: str) -> Column:
    """crc32 of the key as text, modulo 5; a NULL key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def bounded_sample(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """About 0.9 ``most`` rows by the hash of ``columns`` (different for most rows), or all if there are no more than ``most``.

    Nothing is sorted and nothing but a count reaches the driver.  The same rows are taken wherever they lie.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < int(0.9 * most / n * (1 << 40)))


def highest(rows: DataFrame, measure: str, most: int) -> DataFrame:
    """The rows of largest ``measure`` (above 0), as many as fit into ``most`` without cutting through a step of about 1 %.

    The threshold comes from a histogram on a logarithmic scale, some thousand rows at any size.
    """
    step = F.floor(F.log2(measure) * 64).cast("long")
    rows = rows.where(F.col(measure) > 0)
    bins = rows.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in bins:
        total += row["count"]
        if total > most:
            break
        least = row.step
    return rows.where(F.lit(False) if least is None else step >= least)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``limit`` bytes of ``column``, a row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(sizes)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(before, before[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def trimmed(run):
    """``run`` for ``mapInArrow``; at the end of a task the worker, which waits for the next, gives unused memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim is not None:
            trim(0)

    return wrapped


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts with NULL as the empty text."""
    return pc.fill_null(batch.column(column), "")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the texts in order, and their number by text."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    full = np.asarray(pc.binary_length(flat)) > 0
    bounds = np.asarray(parts.offsets, dtype=np.int64)
    bounds = bounds - bounds[0]
    seen = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), np.diff(seen[bounds])


def plain_offsets(array: pa.Array) -> np.ndarray:
    """Offsets of a list, string or binary array, starting at 0."""
    if isinstance(array, pa.ListArray):
        bounds = np.asarray(array.offsets, dtype=np.int64)
    else:
        bounds = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
        bounds = bounds.astype(np.int64)
    return bounds - bounds[0]
