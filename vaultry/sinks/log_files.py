"""The ingest log as files: parts of JSON lines that a version lists in order, replaced or continued as a whole.

A commit stages its lines beside the log and publishes a version that lists them (:mod:`vaultry.sinks.commits`).  Until then readers see the log as it was;
a driver that is repeated under the same operation name finds its version and does nothing.  Earlier versions stay readable: they are the backups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import ledger as log_source
from . import commits


def _parts(folder: str, content: dict) -> list[str]:
    return [f"{folder.rstrip('/')}/{name}" for name in content.get("parts", [])]


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """Log rows of the latest or of an earlier version, in order of ``line_no``."""
    content = commits.current(spark, folder)[1] if version is None else commits.at(spark, folder, version)
    parts = _parts(folder, content)
    if parts:
        return log_source.read(spark, *parts)
    return log_source.parse_lines(spark.createDataFrame([], "line_no bigint, value string"))


def _staged(folder: str, lines: DataFrame, order: Sequence[Column], rows_per_file: int) -> str:
    """The lines written in order as a part of the log; returns its name."""
    name = commits.staged(folder)
    kept = lines.where("value IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    kept.select("value").write.option("maxRecordsPerFile", rows_per_file).text(name)
    return name.rsplit("/", 1)[1]


def append(
    spark: SparkSession, folder: str, lines: DataFrame, order: Sequence[Column], operation: str, rows_per_file: int = 1_000_000
) -> int:
    """Add ``value`` of every row behind the log, sorted by ``order``; returns the version."""

    def write(before: dict) -> dict:
        return {"parts": [*before.get("parts", []), _staged(folder, lines, order, rows_per_file)]}

    return commits.once(spark, folder, operation, write)


def rewrite(
    spark: SparkSession, folder: str, lines, order: Sequence[Column], operation: str, rows_per_file: int = 1_000_000
) -> int:
    """Replace the log by the lines that ``lines(log rows)`` makes of it; returns the version.

    If the log changes meanwhile, the lines are made again from the log as it is then.  ``backup`` in the version's content is the number of
    the version before.
    """

    def write(before: dict) -> dict:
        number = commits.current(spark, folder)[0]
        parts = _parts(folder, before)
        log = log_source.read(spark, *parts) if parts else read(spark, folder)
        return {"parts": [_staged(folder, lines(log), order, rows_per_file)], "backup": number}

    return commits.once(spark, folder, operation, write)


def restore(spark: SparkSession, folder: str, version: int, operation: str) -> int:
    """Make the log what it was in an earlier version; returns the new version."""
    earlier = commits.at(spark, folder, version)
    return commits.once(spark, folder, operation, lambda before: {"parts": earlier.get("parts", []), "backup": version})
