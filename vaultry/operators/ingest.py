"""Which raw files are new, and how they are split into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, paths, skew, vocab
from .ledger import content_hash

_DATE_PREFIX = r"\A(\d{4}-\d{2}-\d{2})"


def companions(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Non-Markdown files that a note next to them (or above ``_resources``) stands for.

    A companion is ``<stem>.md`` or ``<name>.md`` whose first 21 lines hold a ``source:`` line
    naming the file.  ``files``: path; ``notes``: path, content.
    """
    folder = paths.parent(F.col("path"))
    base = F.when(paths.name(folder) == "_resources", paths.parent(folder)).otherwise(folder)
    prefix = F.when(base == "", "").otherwise(F.concat(base, F.lit("/")))
    named = files.where(
        F.lower(paths.suffix(F.col("path"))).isin([e for e in vocab.SOURCE_EXTENSIONS if e != ".md"])
    ).select(
        "path", paths.name(F.col("path")).alias("_name"),
        F.explode(
            F.array(
                F.concat(prefix, paths.stem(F.col("path")), F.lit(".md")),
                F.concat(prefix, paths.name(F.col("path")), F.lit(".md")),
            )
        ).alias("_note"),
    )
    sources = notes.where(F.col("content").contains("source:")).select(
        F.col("path").alias("_note"),
        F.filter(
            F.slice(F.split("content", r"\r\n|\n|\r"), 1, 21), lambda l: l.startswith("source:")
        ).alias("_sources"),
    )
    return (
        named.join(sources, "_note")
        .where(F.exists("_sources", lambda l: l.contains(F.col("_name"))))
        .select("path")
        .distinct()
    )


def new_files(
    candidates: DataFrame, log: DataFrame, protected: DataFrame, with_companion: DataFrame
) -> DataFrame:
    """Candidates (path, mtime, content) that still have to be ingested: path, mtime, hash.

    The cheap tests run first, so only files whose (path, mtime) is not logged are hashed.  The
    log side of every test is reduced to distinct keys before its join.
    """
    logged = log.where(F.coalesce("file", F.lit("")) != "")
    left = candidates.join(protected.select("path"), "path", "left_anti")
    same_time = logged.where("mtime IS NOT NULL").select(F.col("file").alias("path"), "mtime").distinct()
    left = left.join(same_time, ["path", "mtime"], "left_anti")
    left = left.select("path", "mtime", content_hash(F.col("content")).alias("hash"))
    known = logged.where("hash <> ''").select("hash").distinct()
    left = left.join(known, "hash", "left_anti")
    # logged without any hash: the path alone means it was ingested
    unstamped = logged.groupBy(F.col("file").alias("path")).agg(
        F.coalesce(F.bool_or(F.col("hash") != ""), F.lit(False)).alias("_stamped")
    ).where("NOT _stamped")
    left = left.join(unstamped, "path", "left_anti")
    left = left.join(with_companion.select("path"), "path", "left_anti")
    # older layout: a note in converted/ covers the file of the same date in the folder above
    covered = logged.where(F.col("file").rlike(r"(?:\A|/)converted/[^/]*\.md\z")).select(
        paths.parent(paths.parent(F.col("file"))).alias("_folder"),
        F.regexp_extract(paths.name(F.col("file")), _DATE_PREFIX, 1).alias("_day"),
    ).where("_day <> ''").distinct()
    other = F.lower(paths.suffix(F.col("path"))) != ".md"
    keyed = left.withColumns(
        {
            "_folder": F.when(other, paths.parent(F.col("path"))),
            "_day": F.when(other, F.regexp_extract(paths.name(F.col("path")), _DATE_PREFIX, 1)),
        }
    )
    return keyed.join(covered, ["_folder", "_day"], "left_anti").select("path", "mtime", "hash")


def batches(files: DataFrame, per_batch: int = 10) -> DataFrame:
    """Files in ingest order (newest first, then path) with position and batch number."""
    keyed = files.withColumn("order_key", dates.ingest_order_key(F.col("path"), F.col("mtime")))
    placed = skew.numbered(keyed, [F.desc("order_key"), F.asc("path")], "position")
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / per_batch) + 1)


def summary(scanned: DataFrame, new: DataFrame, protected: DataFrame, per_batch: int = 10) -> DataFrame:
    """scanned, new, already imported, protected and the number of batches in one row."""

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    base = scanned.agg(F.count(F.lit(1)).alias("scanned")).withColumns(
        {"new": rows(new), "protected": rows(protected)}
    )
    return base.select(
        "scanned", "new", "protected",
        F.greatest(F.col("scanned") - F.col("new") - F.col("protected"), F.lit(0)).alias("already_imported"),
        F.ceil(F.col("new") / per_batch).alias("batches"),
    )
