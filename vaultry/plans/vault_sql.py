"""DuckDB SQL of the vault projection, shared by the oracles."""

from __future__ import annotations

from ..functions import vocab


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


KINDS = sql_list(vocab.TOPICS)
STATUSES = sql_list(vocab.STATUSES)

PAGES = f"""
pages_v AS (
  SELECT p_partkey AS part_key,
         'wiki/' || {KINDS}[p_partkey % 8 + 1] || '/Part ' || p_partkey || '.md' AS path,
         {KINDS}[p_partkey % 8 + 1] AS kind,
         CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE 'Part ' || p_partkey END AS title,
         CASE WHEN p_partkey % 17 = 0 THEN 'legacy-inferred-minimal'
              WHEN p_partkey % 13 = 0 THEN 'legacy-inferred' END AS migration_status
  FROM part)"""

BLOCKS = f"""
block_rows AS (
  SELECT l_partkey AS part_key, l_orderkey AS ok, l_linenumber AS ln,
         CAST(min(l_shipdate) AS DATE) AS day
  FROM lineitem GROUP BY ALL),
block_given AS (
  SELECT *, NOT (part_key % 5 = 0 OR (part_key % 5 = 1 AND ln = 5)) AS has_provenance,
         {STATUSES}[(ok + ln) % 7 + 1] AS st,
         CASE WHEN part_key % 11 = 3 THEN (ok * 3 + ln) % 200 - 2 ELSE (ok * 3 + ln) % 200 END AS off
  FROM block_rows),
blocks_v AS (
  SELECT part_key, 'wiki/' || {KINDS}[part_key % 8 + 1] || '/Part ' || part_key || '.md' AS path,
         ok * 10 + ln AS ordinal, 'b' || ok || '-' || ln AS id, has_provenance,
         CASE WHEN has_provenance THEN st ELSE 'unknown' END AS status,
         CASE WHEN has_provenance THEN coalesce(['high', 'medium', 'low', NULL][ok % 4 + 1], 'unknown')
              ELSE 'unknown' END AS confidence,
         CASE WHEN has_provenance THEN strftime(day, '%Y-%m-%d') END AS observed,
         CASE WHEN has_provenance AND ok % 6 > 0
              THEN strftime(day + CAST(off AS INTEGER), '%Y-%m-%d') END AS checked,
         CASE WHEN has_provenance AND st = 'superseded' AND ok % 50 > 0 THEN 'b' || (ok + 1) END
           AS superseded_by,
         CASE WHEN has_provenance AND part_key % 17 = 0 THEN 'minimal-risk-stamp' END
           AS provenance_quality,
         CASE WHEN has_provenance AND ok % 2 = 0 THEN 'historical' END AS review_mode,
         CASE WHEN has_provenance AND ok % 5 = 0 THEN '2001-01-01' END AS evidence_latest,
         CASE WHEN has_provenance THEN ok % 3 END AS source_count
  FROM block_given)"""

_CLAIMS = "('current', 'historical', 'stale', 'disputed', 'superseded')"
ISSUES = f"""
issues_v AS (
  SELECT path, id AS block_id, 'missing-sources' AS code, 'warning' AS severity,
         'Block ''' || id || ''' asserts status ''' || status || ''' but lists no sources.' AS message
  FROM blocks_v WHERE has_provenance AND part_key % 17 <> 0 AND status IN {_CLAIMS} AND source_count = 0
  UNION ALL
  SELECT path, id, 'missing-superseded-by', 'error',
         'Superseded block ''' || id || ''' must name superseded_by.'
  FROM blocks_v WHERE has_provenance AND status = 'superseded' AND superseded_by IS NULL
  UNION ALL
  SELECT path, id, 'date-order', 'error',
         'observed must not be later than checked for ''' || id || '''.'
  FROM blocks_v WHERE has_provenance AND observed > checked)"""

STATE = """
state_v AS (
  SELECT p.*, coalesce(b.n, 0) AS block_count, coalesce(b.u, 0) AS unproven_blocks,
         b.last_checked, coalesce(b.d, false) AS has_disputed, coalesce(b.s, false) AS has_stale,
         coalesce(b.x, false) AS has_superseded, coalesce(i.e, false) AS has_error,
         coalesce(i.n, 0) AS issue_count
  FROM pages_v p
  LEFT JOIN (SELECT path, count(*) AS n, count(*) FILTER (NOT has_provenance) AS u,
                    max(checked) AS last_checked, bool_or(status = 'disputed') AS d,
                    bool_or(status = 'stale') AS s, bool_or(status = 'superseded') AS x
             FROM blocks_v GROUP BY path) b USING (path)
  LEFT JOIN (SELECT path, bool_or(severity = 'error') AS e, count(*) AS n
             FROM issues_v GROUP BY path) i USING (path)),
covered_v AS (
  SELECT *, CASE WHEN has_error THEN 'invalid-provenance'
                 WHEN migration_status = 'legacy-inferred-minimal' THEN 'minimal-stamp'
                 WHEN block_count = 0 THEN 'legacy-no-block-ids'
                 WHEN unproven_blocks = 0 THEN 'covered'
                 WHEN unproven_blocks < block_count THEN 'partial-provenance'
                 ELSE 'block-ids-without-provenance' END AS coverage_status
  FROM state_v)"""

RAW = """
notes_v AS (
  SELECT o_orderkey AS order_key, strftime(o_orderdate, '%Y-%m-%d') AS day,
         'raw/notes/' || strftime(o_orderdate, '%Y-%m-%d') || ' Order ' || o_orderkey || '.md' AS path,
         CASE WHEN o_orderkey % 4 = 0 THEN 'part ' || o_custkey ELSE 'order ' || o_orderkey END
           AS title_key,
         CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
         o_orderpriority AS source_type
  FROM orders),
relations_v AS (
  SELECT DISTINCT 'part ' || l_partkey AS title_key, n.path AS note, n.date
  FROM lineitem JOIN notes_v n ON n.order_key = l_orderkey
  UNION
  SELECT title_key, path, date FROM notes_v),
evidence_v AS (
  SELECT title_key, count(*) AS related_raw_count, max(date) AS latest_related_raw_date,
         array_to_string(list(note ORDER BY note)[1:10], '|') AS related_raw
  FROM relations_v GROUP BY title_key)"""

DRIFT = """
keyed_v AS (SELECT *, lower(title) AS title_key, count(*) OVER (PARTITION BY lower(title)) AS same
            FROM state_v),
facts_v AS (
  SELECT k.path AS page, k.title, e.*, k.last_checked AS checked, k.has_disputed, k.has_stale,
         k.has_superseded, k.block_count,
         unproven_blocks > 0 AS r1, block_count = 0 AS r2, same > 1 AS r3,
         same = 1 AND coalesce(latest_related_raw_date > last_checked, false) AS r4,
         same = 1 AND last_checked IS NULL AND latest_related_raw_date IS NOT NULL AS r5
  FROM keyed_v k JOIN evidence_v e USING (title_key)),
drift_v AS (
  SELECT page, title,
         r1::INT * 20 + r2::INT * 35 + r4::INT * 60 + r5::INT * 40 + has_disputed::INT * 30
           + has_stale::INT * 25 + has_superseded::INT * 15 AS score,
         array_to_string(list_filter([
           CASE WHEN r1 THEN 'blocks-without-provenance' END,
           CASE WHEN r2 THEN 'legacy-page-no-block-provenance' END,
           CASE WHEN r3 THEN 'ambiguous-title' END,
           CASE WHEN r4 THEN 'newer-related-raw' END,
           CASE WHEN r5 THEN 'unreviewed-related-raw' END,
           CASE WHEN has_disputed THEN 'disputed-block' END,
           CASE WHEN has_stale THEN 'stale-block' END,
           CASE WHEN has_superseded THEN 'superseded-block' END], lambda x: x IS NOT NULL), '|') AS reasons,
         checked, latest_related_raw_date, related_raw_count, related_raw
  FROM facts_v WHERE r1 OR r2 OR r3 OR r4 OR r5 OR has_disputed OR has_stale OR has_superseded)"""


def with_views(*views: str) -> str:
    return "WITH " + ",".join(views) + "\n"


def score_case(intent: str) -> str:
    status = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.STATUS_SCORES[intent].items())
    confidence = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CONFIDENCE_SCORES.items())
    return f"(CASE status {status} ELSE 0 END + CASE confidence {confidence} ELSE 0 END)"


MONTH = (
    "coalesce(year(CAST(checked AS DATE)) * 12 + month(CAST(checked AS DATE)), 0)"
)
