"""Maintenance of the ingest log: prune, stamp, relink, baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, vocab
from ..sources.ledger import updated_line


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def _merged_list(log: DataFrame, name: str) -> DataFrame:
    """Per file the distinct list items of all its entries in first-seen order.

    Items are reduced to one row per (file, item) before they are gathered, so a file logged
    very often contributes each page once.
    """
    items = log.select("file", "line_no", F.posexplode(name).alias("at", "item"))
    first = items.groupBy("file", "item").agg(F.min(F.struct("line_no", "at")).alias("seen"))
    return first.groupBy("file").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seen", "item"))), lambda e: e["item"]
        ).alias(name)
    )


def prune(log: DataFrame, existing: DataFrame) -> DataFrame:
    """Latest entry per existing file with the page lists of all its entries merged.

    ``existing`` has one ``path`` per file.  The latest entry has the greatest (date, line_no);
    dates compare as text.  Output order is ``line_no`` of the kept entry.
    """
    usable = log.where(~F.col("malformed") & (F.coalesce("file", F.lit("")) != ""))
    # partial aggregation keeps one candidate per file and task; what is left meets the files
    fields = [c for c in usable.columns if c not in ("file", "malformed", "pages_created", "pages_updated")]
    best = usable.groupBy("file").agg(
        F.max_by(F.struct(*fields, "pages_created", "pages_updated"), F.struct("date", "line_no")).alias("e"),
        F.count(F.lit(1)).alias("entries"),
    ).join(existing.select(F.col("path").alias("file")), "file", "left_semi")
    merged = best.join(_merged_list(usable, "pages_created").withColumnRenamed("pages_created", "_created"),
                       "file", "left").join(
        _merged_list(usable, "pages_updated").withColumnRenamed("pages_updated", "_updated"), "file", "left"
    )

    def pages(own: str, union: str, given: str) -> Column:
        # a single entry keeps its list as written; an absent list stays absent unless others had one
        several = F.when(
            F.col(union).isNotNull(), F.col(union)
        ).when(F.col(f"e.{given}"), F.array().cast("array<string>"))
        alone = F.when(
            F.col(f"e.{given}"), F.coalesce(F.col(f"e.{own}"), F.array().cast("array<string>"))
        )
        return F.when(F.col("entries") > 1, several).otherwise(alone).alias(own)

    return merged.select(
        "file", *[F.col(f"e.{c}") for c in fields if c not in ("has_created", "has_updated")],
        pages("pages_created", "_created", "has_created"),
        pages("pages_updated", "_updated", "has_updated"),
        "entries",
    )


def pruned_lines(log: DataFrame, existing: DataFrame) -> DataFrame:
    """Lines of the pruned log (line_no, value): the kept entries as written, with the merged page lists."""
    kept = prune(log, existing)
    return kept.select(
        "line_no", updated_line(F.col("raw"), {"pages_created": F.col("pages_created"), "pages_updated": F.col("pages_updated")}).alias("value")
    )


def baseline_lines(entries: DataFrame) -> DataFrame:
    """Entries of :func:`baseline` as JSON lines: file, value."""
    names_ = ["date", "session", "file", "summary", "pages_created", "pages_updated", "hash", "mtime", "migration_baseline"]
    return entries.select("file", F.to_json(F.struct(*names_)).alias("value"))


def prune_counts(log: DataFrame, existing: DataFrame) -> DataFrame:
    """kept, dropped (no such file), malformed, duplicates in one row."""
    kept = prune(log, existing).agg(
        F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum(F.col("entries") - 1), F.lit(0)).alias("duplicates")
    )
    totals = log.agg(
        F.count_if("malformed").alias("malformed"), F.count_if(~F.col("malformed")).alias("_valid")
    )
    valid = totals.select("_valid").scalar()
    return kept.select(
        "kept", (valid - F.col("kept") - F.col("duplicates")).alias("dropped"),
        totals.select("malformed").scalar().alias("malformed"), "duplicates",
    )


def stamp(log: DataFrame, files: DataFrame) -> DataFrame:
    """Fill missing hash and mtime of entries whose file exists: (path, hash, mtime) in ``files``.

    Values already present are never replaced.  ``stamped`` marks changed rows.
    """
    current = files.select(
        F.col("path").alias("file"), F.col("hash").alias("_hash"), F.col("mtime").alias("_mtime")
    )
    joined = log.join(current, "file", "left")
    incomplete = F.col("hash").isNull() | F.col("mtime").isNull()
    return joined.withColumns(
        {
            "stamped": ~F.col("malformed") & incomplete & F.col("_hash").isNotNull(),
            "hash": F.coalesce("hash", "_hash"),
            "mtime": F.coalesce("mtime", "_mtime"),
        }
    ).drop("_hash", "_mtime")


def relink(log: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is gone, with the file that now holds the same bytes.

    ``files``: path, hash, mtime of all vault files.  Result: line_no, file, hash, new_file,
    new_mtime, outcome (relinked / ambiguous / claimed / missing).  With a single unreferenced
    candidate the first entry in log order takes it; with several the hash is ambiguous.
    """
    named = log.where(F.coalesce("file", F.lit("")) != "")
    gone = named.where(F.col("hash").isNotNull()).select("line_no", "file", "hash").join(
        files.select(F.col("path").alias("file")), "file", "left_anti"
    )
    sources = files.where(
        F.col("path").startswith("raw/")
        & F.lower(paths.suffix(F.col("path"))).isin(vocab.SOURCE_EXTENSIONS)
    )
    free = sources.join(named.select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    candidates = free.groupBy("hash").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("path").alias("new_file"),
        F.min_by("mtime", "path").alias("new_mtime"),
    )
    first = gone.groupBy("hash").agg(F.min("line_no").alias("first_line"))
    decided = candidates.join(first, "hash")
    joined = gone.join(decided, "hash", "left")
    outcome = (
        F.when(F.col("candidates").isNull(), "missing")
        .when(F.col("candidates") > 1, "ambiguous")
        .when(F.col("line_no") == F.col("first_line"), "relinked")
        .otherwise("claimed")
    )
    taken = F.col("outcome") == "relinked"
    return joined.withColumn("outcome", outcome).select(
        "line_no", "file", "hash", "outcome",
        F.when(taken, F.col("new_file")).alias("new_file"),
        F.when(taken, F.col("new_mtime")).alias("new_mtime"),
    )


def apply_relinks(log: DataFrame, relinks: DataFrame) -> DataFrame:
    taken = relinks.where("outcome = 'relinked'").select("line_no", "new_file", "new_mtime")
    return log.join(taken, "line_no", "left").withColumns(
        {
            "file": F.coalesce("new_file", "file"),
            "mtime": F.when(F.col("new_file").isNotNull(), F.col("new_mtime")).otherwise(F.col("mtime")),
        }
    ).drop("new_file", "new_mtime")


def baseline(candidates: DataFrame, log: DataFrame, protected: DataFrame, now: str) -> DataFrame:
    """Log entries for raw files that neither path nor content hash ties to the log.

    ``candidates``: path, hash, mtime; ``protected``: path.
    """
    usable = candidates.join(protected.select("path"), "path", "left_anti")
    by_path = log.where("file IS NOT NULL").select(F.col("file").alias("path")).distinct()
    by_hash = log.where("hash IS NOT NULL").select("hash").distinct()
    new = usable.join(by_path, "path", "left_anti")
    new = new.join(by_hash, "hash", "left_anti")
    none = F.array().cast("array<string>")
    return new.select(
        F.lit(now).alias("date"), F.lit("migration-baseline").alias("session"),
        F.col("path").alias("file"),
        F.lit("Existing raw file baselined during migration; not ingested by this run.").alias("summary"),
        none.alias("pages_created"), none.alias("pages_updated"), "hash", "mtime",
        F.lit(True).alias("migration_baseline"),
    )
