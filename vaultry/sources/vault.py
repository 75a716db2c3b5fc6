"""Listing and reading a vault on a shared file system.

Spark's file sources hide names that begin with ``_`` or ``.``; index pages and resource folders do.  So tasks list the folders, a job for
each level of the tree: the folders of a level are dealt out, and what they hold becomes rows.  The driver sees no names.  Files are then
dealt out by size for reading, so one flat folder is the work of many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed

SCHEMA = "path string, length bigint, mtime bigint, content binary"
#: Bytes that a task reads, about; entries of a batch while listing; bytes and files of a batch while reading.
SPLIT_BYTES, LIST_ROWS, BATCH_BYTES, BATCH_FILES = 128 << 20, 10_000, 16 << 20, 5000


def _entries(folders: DataFrame, root: str) -> DataFrame:
    """Files and visible folders directly in ``folders`` (path): path, is_folder, length, mtime."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "is_folder", "length", "mtime"]
        for batch in batches:
            for folder in batch["path"]:
                out = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        rel = os.path.join(folder, entry.name)
                        if entry.is_dir():
                            # like a walk: links to folders are not followed
                            if not entry.name.startswith(".") and not entry.is_symlink():
                                out.append((rel, True, 0, 0))
                        elif entry.is_file():
                            stat = entry.stat()
                            out.append((rel, False, stat.st_size, int(stat.st_mtime)))
                        if len(out) >= LIST_ROWS:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return folders.mapInPandas(rows, "path string, is_folder boolean, length bigint, mtime bigint")


def listed(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Files of a vault without dot folders: path, length, mtime."""
    root = os.path.abspath(root)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        entries = checkpointed(_entries(folders, root))
        levels.append(entries.where("NOT is_folder").select("path", "length", "mtime"))
        deeper = entries.where("is_folder").select("path")
        if deeper.isEmpty():
            break
        folders = deeper.repartition(tasks, "path")
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found


def read(spark: SparkSession, root: str, content: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Files of a vault without dot folders: path, length, mtime, content (NULL when not read)."""
    root = os.path.abspath(root)
    files = listed(spark, root)
    if not content:
        return files.withColumn("content", F.lit(None).cast("binary"))
    total, number = files.agg(F.sum("length"), F.count(F.lit(1))).first()
    # by a hash of the path: files of one folder, and large ones, come apart
    parts = min(max(-(-(total or 0) // split_bytes), 1, min(number, spark.sparkContext.defaultParallelism)), 1_000_000)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "length", "mtime", "content"]
        for batch in batches:
            out, size = [], 0
            for path, length, mtime in zip(batch["path"], batch["length"], batch["mtime"]):
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                out.append((path, length, mtime, data))
                size += len(data)
                if size > BATCH_BYTES or len(out) >= BATCH_FILES:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return files.repartition(parts, "path").mapInPandas(rows, SCHEMA)


def after_moves(files: DataFrame, moves: DataFrame) -> DataFrame:
    """The same table with the paths that moves (old, new) give, without reading anything again."""
    renamed = files.join(moves.select(F.col("old").alias("path"), F.col("new").alias("_new")), "path", "left")
    return renamed.withColumn("path", F.coalesce("_new", "path")).select(files.columns)


def as_text(files: DataFrame, strict: bool = False) -> DataFrame:
    """Content decoded as UTF-8; ``strict`` drops files that are not valid UTF-8."""
    if strict:
        return files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn(
            "content", F.col("content").cast("string")
        )
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))
