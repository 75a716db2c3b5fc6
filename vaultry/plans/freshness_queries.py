"""Ranking, drift, coverage and curation over the projected vault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking, vocab
from ..operators import coverage, curation, drift, freshness, inventory, provenance
from ..operators.page_state import page_state
from ..sources.tables import table
from . import projection as vault
from .registry import query
from .vault_sql import (
    BLOCKS, DRIFT, ISSUES, MONTH, PAGES, RAW, STATE, score_case, with_views,
)

QUESTIONS = {
    "current": "What is the current state?",
    "history": "Which plan was the original one?",
    "change": "How has it changed over time?",
}
TOP = 50


def joined(c: str):
    return F.array_join(c, "|").alias(c)


def _actions(intent: str) -> str:
    ladder = {
        "history": "WHEN status IN ('historical', 'superseded') THEN 'prefer' "
                   "WHEN status = 'current' THEN 'current-context' ELSE 'rank-lower-explain'",
        "change": "WHEN status IN ('current', 'historical', 'superseded', 'stale') THEN 'compare' "
                  "ELSE 'rank-lower-explain'",
        "current": "WHEN status = 'current' THEN 'prefer' "
                   "WHEN status = 'superseded' THEN 'do-not-use-as-current' "
                   "WHEN status IN ('historical', 'stale', 'disputed') THEN 'rank-lower-explain' "
                   "ELSE 'verify-before-using'",
    }[intent]
    return f"CASE WHEN provenance_quality = 'minimal-risk-stamp' THEN 'use-as-page-caution' {ladder} END"


def _rank_sql(intent: str, limit: int | None) -> str:
    tail = "" if limit is None else f"WHERE rank <= {limit}"
    return with_views(PAGES, BLOCKS) + f"""
      SELECT * FROM (
        SELECT row_number() OVER (ORDER BY freshness_score DESC, m DESC, id, path, ordinal) AS rank,
               path, id, status, confidence, checked, freshness_score, freshness_action
        FROM (SELECT b.*, {score_case(intent)} AS freshness_score, {MONTH} AS m,
                     {_actions(intent)} AS freshness_action
              FROM blocks_v b JOIN pages_v USING (path))) {tail}"""


def _ranked(spark: SparkSession, sf: str, intent: str, limit: int | None) -> DataFrame:
    columns = ["rank", "path", "id", "status", "confidence", "checked", "freshness_score", "freshness_action"]
    ranked = freshness.rank(vault.block_facts(spark, sf), QUESTIONS[intent], limit, columns)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


@query("freshness_rank_current", _rank_sql("current", TOP))
def freshness_rank_current(spark, sf):
    return _ranked(spark, sf, "current", TOP)


@query("freshness_rank_history", _rank_sql("history", TOP))
def freshness_rank_history(spark, sf):
    return _ranked(spark, sf, "history", TOP)


@query("freshness_rank_change", _rank_sql("change", TOP))
def freshness_rank_change(spark, sf):
    return _ranked(spark, sf, "change", TOP)


@query("freshness_rank_all", _rank_sql("current", None))
def freshness_rank_all(spark, sf):
    return _ranked(spark, sf, "current", None)


_NOTE_DATES = """CASE WHEN observed IS NULL AND checked IS NULL THEN 'no dates recorded'
  ELSE concat_ws(', ', 'observed ' || observed, 'checked ' || checked) END"""
_NOTE_SQL = f"""
  SELECT path, id, q AS query_intent,
    CASE WHEN provenance_quality = 'minimal-risk-stamp' THEN
      'Minimal page-level freshness stamp only;'
      || coalesce(' latest related evidence ' || evidence_latest || ';', '')
      || coalesce(' review mode ' || review_mode || ';', '')
      || ' detailed page claims are not yet block-mapped' || tail
    WHEN q = 'history' THEN
      CASE status WHEN 'historical' THEN 'historical block' || tail
        WHEN 'superseded' THEN 'Superseded block remains useful for history' || tail || succ
        ELSE status || ' block used as supporting context for a history query' || tail END
    WHEN q = 'change' THEN status || ' block can be compared in a change-over-time answer' || tail
    WHEN status = 'current' THEN 'current block' || tail
    WHEN status = 'historical' THEN 'historical block; rank lower for current-state answers' || tail
    WHEN status = 'stale' THEN 'Stale block; rank lower and explain freshness uncertainty' || tail
    WHEN status = 'disputed' THEN
      'Disputed block; do not present without explaining the dispute' || tail
    WHEN status = 'superseded' THEN 'Superseded block; do not use as the current answer' || tail || succ
    ELSE 'Freshness is ' || status || '; verify before using for a current-state answer' || tail
    END AS freshness_note
  FROM (SELECT *, '; ' || confidence || ' confidence; ' || {_NOTE_DATES} || '.' AS tail,
               coalesce(' Superseded by ' || superseded_by || '.', '') AS succ
        FROM blocks_v CROSS JOIN (SELECT unnest(['current', 'history', 'change']) AS q))"""


@query("freshness_actions_notes", with_views(PAGES, BLOCKS) + _NOTE_SQL)
def freshness_actions_notes(spark, sf):
    blocks = vault.block_facts(spark, sf)
    asked = blocks.withColumn("question", F.explode(F.array(*map(F.lit, QUESTIONS.values()))))
    return freshness.annotate(asked, F.col("question")).select(
        "path", "id", "query_intent", "freshness_note"
    )


def _words(words: list[str]) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(words) + r")($|[^\p{L}\p{N}_])"


_ASK = [("", ""), ("Did the plan change? ", "2"), ("It evolved: ", "3")]


@query(
    "query_intent",
    f"""SELECT doc_id * 3 + i AS question_id,
          CASE WHEN regexp_matches(q, '{_words(vocab.CHANGE_WORDS)}', 'i') THEN 'change'
               WHEN regexp_matches(q, '{_words(vocab.HISTORY_WORDS)}', 'i') THEN 'history'
               ELSE 'current' END AS query_intent
        FROM (SELECT doc_id, i, ['', 'Did the plan change? ', 'Evolved: '][CAST(i AS INTEGER) + 1] || text AS q
              FROM documents CROSS JOIN range(3) t(i))""",
)
def query_intent(spark, sf):
    """Intent of every document read as a question, plain and behind two literal questions."""
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.posexplode(F.array(*map(F.lit, ["", "Did the plan change? ", "Evolved: "]))).alias("i", "lead"),
        "text",
    )
    return docs.select(
        (F.col("doc_id") * 3 + F.col("i")).alias("question_id"),
        ranking.query_intent(F.concat("lead", "text")).alias("query_intent"),
    )


def state(spark, sf):
    return page_state(
        vault.pages(spark, sf), vault.block_facts(spark, sf), vault.block_issues(spark, sf)
    )


_STATE_VIEWS = (PAGES, BLOCKS, ISSUES, STATE)


@query(
    "provenance_lint",
    with_views(PAGES, BLOCKS, ISSUES) + "SELECT path, block_id, code, severity, message FROM issues_v",
)
def provenance_lint(spark, sf):
    return vault.block_issues(spark, sf).select("path", "block_id", "code", "severity", "message")


@query(
    "provenance_lint_summary",
    with_views(PAGES, BLOCKS, ISSUES)
    + """SELECT (SELECT count(*) FROM pages_v) AS files, count(*) AS issues,
         count(*) FILTER (severity = 'error') AS errors,
         count(*) FILTER (severity = 'warning') AS warnings FROM issues_v""",
)
def provenance_lint_summary(spark, sf):
    return provenance.lint_summary(vault.pages(spark, sf), vault.block_issues(spark, sf))


@query(
    "inventory_summary",
    with_views(PAGES, BLOCKS, ISSUES)
    + """SELECT (SELECT count(*) FROM pages_v) AS wiki_pages,
         (SELECT count(*) FROM orders) AS raw_notes, count(*) AS canonical_blocks,
         count(*) FILTER (has_provenance) AS blocks_with_provenance,
         count(*) FILTER (NOT has_provenance) AS blocks_without_provenance,
         (SELECT count(*) FROM pages_v WHERE migration_status = 'legacy-inferred')
           AS legacy_inferred_pages,
         (SELECT count(*) FROM issues_v) AS validation_issues
       FROM blocks_v""",
)
def inventory_summary(spark, sf):
    return inventory.summary(
        vault.pages(spark, sf), vault.raw_notes(spark, sf), vault.block_facts(spark, sf),
        vault.block_issues(spark, sf),
    )


@query(
    "legacy_pages",
    with_views(*_STATE_VIEWS)
    + """SELECT path, title, issue_count, reason FROM (
         SELECT *, CASE WHEN has_error THEN 'invalid-provenance'
                        WHEN block_count = 0 THEN 'no-block-provenance'
                        WHEN unproven_blocks > 0 THEN 'blocks-without-provenance' END AS reason
         FROM state_v) WHERE reason IS NOT NULL""",
)
def legacy_pages(spark, sf):
    return freshness.legacy_pages(state(spark, sf))


_PRIORITY = """CASE coverage_status WHEN 'invalid-provenance' THEN 100 WHEN 'partial-provenance' THEN 80
  WHEN 'block-ids-without-provenance' THEN 70 WHEN 'minimal-stamp' THEN 45 ELSE
  CASE WHEN kind IN ('decisions', 'problems', 'systems', 'projects') THEN 50
       WHEN kind IN ('concepts', 'competition') THEN 40 WHEN kind = 'people' THEN 30 ELSE 20 END END"""


@query(
    "coverage_backlog",
    with_views(*_STATE_VIEWS)
    + f"""SELECT path, title, kind, coverage_status, block_count, issue_count, {_PRIORITY} AS priority
          FROM covered_v WHERE coverage_status <> 'covered'""",
)
def coverage_backlog(spark, sf):
    return coverage.ordered(coverage.backlog(state(spark, sf)))


@query(
    "coverage_counts",
    with_views(*_STATE_VIEWS)
    + """SELECT 'status' AS facet, coverage_status AS value, count(*) AS pages FROM covered_v GROUP BY ALL
         UNION ALL SELECT 'kind', kind, count(*) FROM covered_v GROUP BY ALL""",
)
def coverage_counts(spark, sf):
    return coverage.counts(state(spark, sf))


@query(
    "coverage_summary",
    with_views(*_STATE_VIEWS)
    + """SELECT count(*) AS wiki_pages, count(*) FILTER (coverage_status = 'covered') AS covered_pages,
         count(*) FILTER (coverage_status <> 'covered') AS backlog_pages FROM covered_v""",
)
def coverage_summary(spark, sf):
    return coverage.summary(state(spark, sf))


_DRIFT_VIEWS = (*_STATE_VIEWS, RAW, DRIFT)


def drift_rows(spark, sf):
    return drift.detect(state(spark, sf), vault.relations(spark, sf))


@query(
    "drift_candidates",
    with_views(*_DRIFT_VIEWS)
    + """SELECT page, title, score, reasons, checked, latest_related_raw_date, related_raw_count,
                related_raw FROM drift_v""",
)
def drift_candidates(spark, sf):
    return drift.ordered(drift_rows(spark, sf)).select(
        "page", "title", "score", joined("reasons"), "checked", "latest_related_raw_date",
        "related_raw_count", joined("related_raw"),
    )


@query(
    "drift_ambiguous_titles",
    with_views(PAGES)
    + "SELECT lower(title) AS title_key, count(*) AS pages FROM pages_v GROUP BY ALL HAVING count(*) > 1",
)
def drift_ambiguous_titles(spark, sf):
    return drift.ambiguous_titles(vault.pages(spark, sf))


@query(
    "curation_packet",
    with_views(*_DRIFT_VIEWS)
    + """SELECT s.path, s.block_count, coalesce(d.score, 0) AS score, coalesce(d.reasons, '') AS reasons,
           coalesce(d.related_raw_count, 0) AS related_raw_count,
           coalesce(d.related_raw, '') AS related_raw,
           'confirm|revise|split|move-to-history'
             || CASE WHEN s.has_superseded OR coalesce(contains(d.reasons, 'newer-related-raw'), false)
                     THEN '|supersede' ELSE '' END
             || CASE WHEN s.has_disputed THEN '|resolve-dispute' ELSE '' END
             || CASE WHEN s.block_count = 0 THEN '|add-block-provenance' ELSE '' END
             AS suggested_actions
         FROM state_v s LEFT JOIN drift_v d ON d.page = s.path""",
)
def curation_packet(spark, sf):
    pages = state(spark, sf)
    rows = curation.packets(pages, drift.detect(pages, vault.relations(spark, sf)))
    return rows.select(
        "path", "block_count", "score", joined("reasons"), "related_raw_count", joined("related_raw"),
        joined("suggested_actions"),
    )
