"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of ``doc_id`` and sorted, so the files in order hold the ids in ascending order.  Each file
keeps positions relative to its own start; a manifest with a row for every file has the totals before it.  Stripes
are the unit of parallel reading, their statistics and Bloom filters prune reads of single documents.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .piece_table import PieceTable, resolve
from .shared import text_slices, texts_of, trimmed, work_folder

#: Chunks whose ids a worker keeps; a bound on memory only.
KNOWN_PIECES = 4_000_000


@dataclass(frozen=True)
class TokenFiles:
    """A written set: ``data`` and ``manifest`` are folders."""

    data: str
    manifest: str


@functools.lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, PieceTable(KNOWN_PIECES)


def _ids_of(words: pa.Array, path: str) -> pa.ListArray:
    """Ids of different chunks by the tokenizers library; a worker encodes a piece again only after it has forgotten it."""
    tokenizer, known = _library(path)
    return resolve(
        words, known, lambda new: [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
    )


def write(
    docs: DataFrame, tokenizer: str, end_id: int = 0, files: int | None = None, stripe_bytes: int = 64 << 20,
    index_rows: int = 1000,
) -> TokenFiles:
    """Encode ``doc_id, text`` of every row and write the ids with ``end_id`` after each document.

    A NULL or empty text is its end id alone.  Rows with a NULL ``doc_id`` come first; rows with one ``doc_id`` are written
    each, sorted by a digest of their texts.  Other columns are not read.  An empty table gives an empty set.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "tokens")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    keys = (F.col("doc_id"),)
    ranged = narrow.repartitionByRange(files, *keys) if files else narrow.repartitionByRange(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                flat, bounds = chunks.encode(texts_of(part), lambda w: _ids_of(w, tokenizer))
                n = len(part)
                ends = bounds + np.arange(n + 1)  # an end id more for every document before
                ids = np.full(ends[-1], end_id, np.int32)
                place = np.ones(len(ids), bool)
                place[ends[1:] - 1] = False
                ids[place] = flat
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "file_start": pa.array(at + ends[:-1]),
                    "n_tokens": pa.array(np.diff(ends)),
                    "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                })
                at += int(ends[-1])

    # rows of one doc_id lie in one range: a digest of the text orders them, so positions do not change between runs
    rows = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"), "text").mapInArrow(
        trimmed(run), "doc_id long, file_start long, n_tokens long, ids array<int>"
    )
    out = TokenFiles(f"{folder}/data", f"{folder}/manifest")
    (
        rows.write.format("orc").option("compression", "zstd").option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true").option("orc.row.index.stride", index_rows)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").save(out.data)
    )
    sizes = (
        spark.read.schema("doc_id long, n_tokens long").orc(out.data).groupBy(_part().alias("part"))
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"),
             F.sum("n_tokens").alias("n_tokens"))
    )
    # one row for every file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(out.manifest)
    return out


def _part() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")


def read(spark: SparkSession, files: TokenFiles, wanted: Column | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents ``wanted`` (a condition on ``doc_id``), or of all."""
    data = spark.read.schema("doc_id long, file_start long, n_tokens long, ids array<int>").orc(files.data)
    data = data.withColumn("part", _part())
    starts = spark.read.parquet(files.manifest).select("part", F.col("start").alias("base"))
    if wanted is not None:
        data = data.where(wanted)
    # a row for every file that was written: no more rows than the write had partitions
    joined = data.join(F.broadcast(starts), "part")
    return joined.select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows of :func:`read`; the crc is of the ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets, np.int64) * 4
            raw = memoryview(np.asarray(lists.values, np.int32).astype("<u4", copy=False).tobytes())
            at = bounds.tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"),
                "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
            })

    return rows.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
