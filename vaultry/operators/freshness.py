"""Ranking of canonical blocks for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, paths, ranking, skew
from . import mapping
from .page_state import legacy_reason

# Columns of a block that an annotation reads.
_NOTE_COLUMNS = [
    "status", "confidence", "observed", "checked", "provenance_quality", "superseded_by",
    "evidence_latest", "review_mode",
]


# Block columns behind each annotation.
_READ = {
    "freshness_score": ["status", "confidence"],
    "freshness_action": ["status", "provenance_quality"],
    "freshness_note": _NOTE_COLUMNS,
}


def _with_intent(blocks: DataFrame, question: str | Column) -> DataFrame:
    asked = F.lit(question) if isinstance(question, str) else question
    return blocks.withColumn("query_intent", ranking.query_intent(asked))


def _annotation(name: str) -> Column:
    reading = {"freshness_score": ranking.score, "freshness_action": ranking.action, "freshness_note": ranking.note}[name]
    return reading(*[F.col(c) for c in _READ[name]], F.col("query_intent"))


def annotate(blocks: DataFrame, question: str | Column) -> DataFrame:
    """Blocks plus query_intent, freshness_score, freshness_action and freshness_note."""
    return _with_intent(blocks, question).withColumns({name: _annotation(name) for name in _READ})


def _order() -> list[Column]:
    return [
        F.desc("freshness_score"), F.desc("_month"), F.asc("id"),
        F.asc("_page_order"), F.asc("ordinal"),
    ]


def _order_keys() -> dict[str, Column]:
    return {
        "_month": ranking.check_month(F.col("checked")),
        "_page_order": paths.component_order(F.col("path")),
    }


def _ranked_in_full(blocks: DataFrame, question: str | Column, columns: list[str] | None) -> DataFrame:
    """Every block with its rank; what follows from columns of the block is added after the sort."""
    rows = _with_intent(blocks, question)
    kept = columns or list(dict.fromkeys([*rows.columns, *_READ, "rank"]))
    read = {c for name in _READ if name in kept for c in _READ[name]} | {"query_intent"}
    carried = [c for c in rows.columns if c in read or c in kept and c not in _READ]
    keyed = rows.withColumns({"freshness_score": _annotation("freshness_score"), **_order_keys()}).select(
        *dict.fromkeys([*carried, "id", "ordinal", "freshness_score", "_month", "_page_order"])
    )
    placed = skew.numbered(keyed, _order(), "rank", kept=carried)
    return placed.withColumns({name: _annotation(name) for name in _READ if name in kept}).select(*kept)


def rank(
    blocks: DataFrame, question: str | Column, limit: int | None = 10, columns: list[str] | None = None
) -> DataFrame:
    """Blocks in order of suitability with their rank; no block is filtered out.

    With a limit the plan is a distributed top-k.  ``limit=None`` ranks every block and numbers
    them by range partitions.  ``columns`` are those of the result, all when None: a sort of all
    blocks carries no others.
    """
    if limit is None:
        return _ranked_in_full(blocks, question, columns)
    keyed = annotate(blocks, question).withColumns(_order_keys())
    # the window sees at most `limit` rows
    ranked = keyed.orderBy(*_order()).limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(*_order()))
    ).drop("_month", "_page_order")
    return ranked if columns is None else ranked.select(*columns)


def selected_pages(pages: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Pages asked for, in request order (``requested``: ordinal, page); all when None.

    Raises ``FileNotFoundError`` naming every requested page that does not exist.
    """
    if requested is None:
        return pages.withColumn("ordinal", F.lit(None).cast("bigint"))
    wanted = requested.select(
        "ordinal", names.page_argument(F.col("page")).alias("path")
    )
    # the request is user input: its misses are reported in one message
    missing = wanted.join(pages.select("path"), "path", "left_anti").orderBy("ordinal")
    absent = [row["path"] for row in missing.select("path").collect()]
    if absent:
        raise FileNotFoundError(f"Wiki page not found: {', '.join(absent)}")
    return pages.join(wanted, "path")


def legacy_pages(state: DataFrame) -> DataFrame:
    """Pages that need caution, with the reason."""
    return state.withColumn("reason", legacy_reason()).where("reason IS NOT NULL").select(
        "path", "title", "reason", "issue_count"
    )


def packet(
    state: DataFrame, blocks: DataFrame, question: str, requested: DataFrame | None = None,
    limit: int = 10,
) -> dict[str, DataFrame]:
    """All tables that answer one question."""
    chosen = selected_pages(state, requested)
    candidates = blocks if requested is None else blocks.join(
        chosen.select("path").distinct(), "path", "left_semi"
    )
    candidates = candidates.join(state.select("path", "title"), "path")
    return {
        "candidate_pages": chosen.select("ordinal", "path"),
        "ranked_blocks": rank(candidates, question, limit),
        "total": candidates.agg(F.count(F.lit(1)).alias("total_ranked_blocks")),
        "legacy_pages": legacy_pages(chosen),
    }


def hit_packet(
    state: DataFrame, blocks: DataFrame, question: str, hits: DataFrame, notes: DataFrame,
    requested: DataFrame | None = None, limit: int | None = 10,
) -> dict[str, DataFrame]:
    """All tables that answer one question from search hits.

    ``hits`` from :func:`mapping.resolve_hits`; ``notes``: path, title, content of raw notes; ``requested``: ordinal, page.
    Candidates are the requested pages, the pages hit, and the pages that a hit note supports, in this order.  Notes that
    support no page stay as evidence, hits that mean nothing are listed as unresolved.
    """
    hit_notes = notes.join(hits.where("family = 'raw' AND first").select("path"), "path", "left_semi")
    mapped = mapping.map_notes(hit_notes, state)
    if requested is None:
        asked = state.select("path", F.lit(0).alias("ordinal")).limit(0)
    else:
        asked = selected_pages(state, requested).select("path", "ordinal")
    candidates = mapping.candidate_pages(asked, hits, mapped)
    chosen = state.join(candidates.select("path"), "path", "left_semi")
    inside = blocks.join(chosen.select("path", "title"), "path")
    return {
        "candidate_pages": candidates,
        "ranked_blocks": rank(inside, question, limit),
        "total": inside.agg(F.count(F.lit(1)).alias("total_ranked_blocks")),
        "legacy_pages": legacy_pages(chosen),
        "raw_mappings": mapped,
        "raw_evidence": mapping.unmapped_notes(hit_notes, mapped).select("path", "reason"),
        "unresolved": hits.where("family = 'unresolved'").select("rank", "id"),
    }
