"""Raw files kept out of ingestion: notes saying ``ingest: false`` and what they link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, links, paths, text, vocab


def is_source(path: Column) -> Column:
    """Raw source file; extensions compare without case."""
    return path.startswith("raw/") & F.lower(paths.suffix(path)).isin(vocab.SOURCE_EXTENSIONS)


def is_ingest_candidate(path: Column) -> Column:
    """Ingest candidate; extensions compare with case and hidden folders count."""
    return path.startswith("raw/") & F.regexp_extract(path, r"(\.[^./]+)\z", 1).isin(vocab.SOURCE_EXTENSIONS)


def protected_notes(notes: DataFrame) -> DataFrame:
    """Markdown notes (path, content) that refuse ingestion, with their cleaned link targets."""
    # the substring test spares other notes the line split
    refusing = notes.where(
        F.lower(paths.suffix(F.col("path"))).eqNullSafe(".md")
        & F.lower(F.col("content")).contains("ingest")
    ).withColumn("_front", frontmatter.closed_lines(text.lines(F.col("content"))))
    return refusing.where(frontmatter.says_ingest_false(F.col("_front"))).select(
        "path", links.file_targets(F.col("content"), F.col("_front")).alias("targets")
    )


def _closure(notes: DataFrame, wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, linked_from) for protected notes and the candidates they reach in one hop."""
    own = notes.select("path", F.lit(None).cast("string").alias("linked_from"))
    reached = wanted.join(candidates.select(F.col("path").alias("key")), "key").where(
        F.col("key") != F.col("linked_from")
    )
    return own.unionByName(reached.select(F.col("key").alias("path"), "linked_from")).distinct()


def closure_relative(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Protection as the inventory and the baseline see it.

    Targets below ``raw/`` count from the root, others from the folder of the note.  A target
    without extension also stands for the eight source extensions.
    """
    cleaned = notes.select(
        F.col("path").alias("linked_from"),
        F.explode_outer(F.transform("targets", lambda t: links.cleaned_target(t))).alias("target"),
    ).where("target IS NOT NULL AND NOT startswith(target, '/')")
    folder = paths.parent(F.col("linked_from"))
    full = F.when(F.col("target").startswith("raw/"), F.col("target")).otherwise(
        F.concat(folder, F.lit("/"), F.col("target"))
    )
    bare = paths.suffix(F.col("_full")) == ""
    variants = F.when(
        bare,
        F.array(F.col("_full"), *[F.concat(F.col("_full"), F.lit(e)) for e in vocab.SOURCE_EXTENSIONS]),
    ).otherwise(F.array("_full"))
    wanted = cleaned.withColumn("_full", paths.resolved(full)).where("_full IS NOT NULL").select(
        "linked_from", F.explode(variants).alias("key")
    ).distinct()
    return _closure(notes, wanted, candidates)


def _named_keys(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (``linked_from, key``) and bare names (``linked_from, _name``) that protected notes mean."""
    cleaned = notes.select(
        F.col("path").alias("linked_from"),
        F.explode_outer(
            F.transform("targets", lambda t: links.cleaned_target(t, cut_anchor=False))
        ).alias("target"),
    ).where("target IS NOT NULL")
    spelled = F.array_distinct(
        F.array(
            F.col("target"), F.substring_index("target", "#", 1), F.substring_index("target", "?", 1),
            F.substring_index(F.substring_index("target", "#", 1), "?", 1),
        )
    )
    rows = cleaned.select("linked_from", F.explode(spelled).alias("target")).where(
        (F.col("target") != "") & ~F.col("target").startswith("/")
    )
    rooted = F.col("target").startswith("raw/")
    keys = rows.select(
        "linked_from", "target",
        F.explode(
            F.when(rooted, F.array(paths.resolved(F.col("target")))).otherwise(
                F.array(
                    paths.resolved(F.concat(paths.parent(F.col("linked_from")), F.lit("/"), F.col("target"))),
                    paths.resolved(F.col("target")),
                )
            )
        ).alias("key"),
    )
    direct = keys.where(F.col("key").startswith("raw/")).select("linked_from", "key")
    bare = rows.where(~F.col("target").contains("/")).select("linked_from", F.col("target").alias("_name")).distinct()
    return direct, bare


def closure_by_name(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Protection as the batch partitioner sees it, with every (note, file) pair.

    Targets also count from the vault root, and a bare file name protects that name in every
    folder; no extension is added.  The pairs are the result; where the files alone are asked for,
    :func:`protected_by_name` has them without pairs.
    """
    direct, bare = _named_keys(notes)
    named = candidates.select(F.col("path").alias("key"), paths.name(F.col("path")).alias("_name"))
    by_name = bare.join(named, "_name").select("linked_from", "key")
    return _closure(notes, direct.unionByName(by_name).distinct(), candidates)


def protected_by_name(notes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Paths of :func:`closure_by_name`: files are kept by semi joins on different paths and names, notes meet no files.

    A note that means only itself is protected anyway.
    """
    direct, bare = _named_keys(notes)
    by_path = candidates.join(direct.select(F.col("key").alias("path")).distinct(), "path", "left_semi")
    by_name = candidates.withColumn("_name", paths.name(F.col("path"))).join(bare.select("_name").distinct(), "_name", "left_semi")
    return notes.select("path").unionByName(by_path.select("path")).unionByName(by_name.select("path")).distinct()


def protected_paths(closure: DataFrame) -> DataFrame:
    return closure.select("path").distinct()


def linked_counts(closure: DataFrame) -> DataFrame:
    """Linked files per protecting note."""
    notes = closure.where("linked_from IS NULL").select(F.col("path").alias("file"))
    counts = closure.where("linked_from IS NOT NULL").groupBy(F.col("linked_from").alias("file")).agg(
        F.count(F.lit(1)).alias("linked_count")
    )
    return notes.join(counts, "file", "left").na.fill(0, ["linked_count"])
