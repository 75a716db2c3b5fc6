"""Pages whose related evidence moved on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links, names, paths, vocab
from .page_state import latest_day

#: Places that share the notes of a title before they are reduced to one row.
PARTS = 16


def note_relations(raw_files: DataFrame, raw_notes: DataFrame | None = None) -> DataFrame:
    """Titles a raw note refers to: (title_key, note, date), from its links and its own title.

    ``raw_files`` carries path and content, ``title`` and ``date`` come from the note index.
    """
    rows = raw_files if raw_notes is None else raw_files.join(
        raw_notes.select("path", "title", "date"), "path"
    )
    stems = F.transform(
        links.title_targets(F.col("content")), lambda t: names.plain_title(paths.stem(t))
    )
    own = F.filter(F.array(names.plain_title(F.coalesce("title", F.lit("")))), lambda t: t != "")
    keys = F.array_union(stems, own)
    return rows.select(
        F.explode_outer(keys).alias("title_key"), F.col("path").alias("note"), "date"
    ).where("title_key IS NOT NULL")


def evidence_by_title(relations: DataFrame, related_limit: int = 10) -> DataFrame:
    """One row per title: number of notes, latest date, the first ``related_limit`` notes.

    The relations are dealt once, a title's notes to ``PARTS`` places by their hash, and sorted once: a part knows each of its notes
    once, counts them and lists its first ones.  Only parts meet by title, so a title that a third of all notes refer to is no
    task's work.
    """
    dealt = relations.where("title_key IS NOT NULL").select(
        "title_key", F.pmod(F.xxhash64("note"), F.lit(PARTS)).alias("_part"), "note", "date"
    ).repartition("title_key", "_part")
    # in a part the notes are numbered; the first row of a note has its least date
    rows = Window.partitionBy("title_key", "_part").orderBy("_order", "note", F.asc_nulls_last("date"))
    notes = Window.partitionBy("title_key", "_part").orderBy("_order", "note")
    placed = dealt.withColumn("_order", paths.component_order(F.col("note"))).withColumns(
        {"_before": F.lag(F.struct("note")).over(rows), "_place": F.dense_rank().over(notes)}
    )
    new = F.col("_before").isNull() | ~F.col("_before.note").eqNullSafe(F.col("note"))
    parts = placed.where(new).groupBy("title_key", "_part").agg(
        F.count(F.lit(1)).alias("_notes"), latest_day(F.col("date")).alias("_latest"),
        F.collect_list(F.when(F.col("_place") <= related_limit, F.struct("note"))).alias("_first"),
    )
    ordered = F.array_sort(
        F.transform(
            F.flatten(F.collect_list("_first")),
            lambda e: F.struct(paths.component_order(e["note"]).alias("order"), e["note"].alias("note")),
        )
    )
    return parts.groupBy("title_key").agg(
        F.sum("_notes").alias("related_raw_count"), F.max("_latest").alias("latest_related_raw_date"),
        F.transform(F.slice(ordered, 1, related_limit), lambda e: e["note"]).alias("related_raw"),
    )


def _reason(when: Column, code: str) -> Column:
    return F.when(
        when, F.struct(F.lit(code).alias("code"), F.lit(vocab.DRIFT_POINTS.get(code, 0)).alias("points"))
    )


def detect(state: DataFrame, relations: DataFrame) -> DataFrame:
    """Curation candidates: page, title, score, reasons, checked, latest_related_raw_date, ..."""
    keyed = state.withColumn("title_key", names.plain_title(F.col("title")))
    multiplicity = keyed.groupBy("title_key").agg(F.count(F.lit(1)).alias("same_title"))
    evidence = evidence_by_title(relations).join(multiplicity, "title_key")
    joined = keyed.join(evidence, "title_key")

    ambiguous = F.col("same_title") > 1
    newer = F.coalesce(F.col("latest_related_raw_date") > F.col("last_checked"), F.lit(False))
    unreviewed = F.col("last_checked").isNull() & F.col("latest_related_raw_date").isNotNull()
    reasons = F.filter(
        F.array(
            _reason(F.col("unproven_blocks") > 0, "blocks-without-provenance"),
            _reason(F.col("block_count") == 0, "legacy-page-no-block-provenance"),
            _reason(ambiguous, "ambiguous-title"),
            _reason(~ambiguous & newer, "newer-related-raw"),
            _reason(~ambiguous & unreviewed, "unreviewed-related-raw"),
            _reason(F.col("has_disputed"), "disputed-block"),
            _reason(F.col("has_stale"), "stale-block"),
            _reason(F.col("has_superseded"), "superseded-block"),
        ),
        lambda r: r.isNotNull(),
    )
    return (
        joined.withColumn("_reasons", reasons)
        .where(F.size("_reasons") > 0)
        .select(
            F.col("path").alias("page"), "title",
            F.aggregate("_reasons", F.lit(0), lambda acc, r: acc + r["points"]).alias("score"),
            F.transform("_reasons", lambda r: r["code"]).alias("reasons"),
            F.col("last_checked").alias("checked"), "latest_related_raw_date",
            "related_raw_count", "related_raw",
        )
    )


def ordered(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("score"), "page")


def ambiguous_titles(pages: DataFrame) -> DataFrame:
    """Titles that more than one page carries."""
    return (
        pages.groupBy(names.plain_title(F.col("title")).alias("title_key"))
        .agg(F.count(F.lit(1)).alias("pages"))
        .where("pages > 1")
    )
