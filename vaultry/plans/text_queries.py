"""Dates, supersession, mapping, retrieval, transcripts, mail and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import (
    contamination, date_assignment, freshness, mail, mapping, page_checks, retrieval, supersession, topics, transcripts,
)
from ..session import checkpointed
from ..sources.tables import table
from . import freshness_queries, projection, text_vault
from .registry import query
from .text_vault import _cat, s
from .vault_sql import BLOCKS, KINDS, MONTH, PAGES, score_case, with_views

MONTH_NAMES = ["Jan", "February", "mar.", "April", "May", "June", "Jul", "August", "Sept", "Oct", "Nov", "December"]


# dates -----------------------------------------------------------------------------------------
def dated_notes(spark, sf):
    """Orders as raw notes whose date sits in the name, a folder, a field, the prose or nowhere."""
    key = F.col("o_orderkey")
    day = lambda f: F.date_format("o_orderdate", f)
    case = key % 10
    name = (
        F.when(case == 0, _cat(day("yyyy-MM-dd"), "_order ", s(key + 100000)))
        .when(case == 1, _cat("Report 1996-", day("yyyy"), " n", s(key + 100000)))
        .when(case == 2, _cat("n", s(key + 100000), " ", day("dd-MM-yyyy")))
        .otherwise(_cat("n", s(key + 100000)))
    )
    folder = F.when(case == 3, _cat("raw/", day("yyyy"), "/")).otherwise("raw/notes/")
    field = (
        F.when(case == 4, _cat('Published: "', day("yyyy-MM-dd"), '"\n'))
        .when(case == 5, _cat("last_modified: ", projection.choose(MONTH_NAMES, F.month("o_orderdate") - 1), " ", day("yyyy"), "\n"))
        .when(case == 6, _cat("created: ", day("yyyy"), "\n"))
        .when(case == 7, "fetched: 2022-02-02\n").otherwise("")
    )
    body = F.when(case == 8, _cat("Sent on ", day("yyyy-MM-dd"), " or 1994-01-01 or 2999-01-01.\n")).otherwise("No day.\n")
    return table(spark, sf, "orders").select(
        _cat(folder, name, ".md").alias("path"), _cat("---\ndate: 1901-01-01\n", field, "---\n", body).alias("content"),
        "o_orderkey", "o_custkey", "o_orderdate",
    )


DATED = r"""
dated_v AS (
  SELECT *, o_orderkey % 10 AS c, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y') AS y,
         CASE WHEN o_orderkey % 10 = 3 THEN 'raw/' || strftime(o_orderdate, '%Y') || '/' ELSE 'raw/notes/' END
         || CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || '_order ' || (o_orderkey + 100000)
              WHEN 1 THEN 'Report 1996-' || strftime(o_orderdate, '%Y') || ' n' || (o_orderkey + 100000)
              WHEN 2 THEN 'n' || (o_orderkey + 100000) || ' ' || strftime(o_orderdate, '%d-%m-%Y')
              ELSE 'n' || (o_orderkey + 100000) END || '.md' AS path FROM orders),
assigned_v AS (
  SELECT o_orderkey, o_custkey, path, c,
    CASE c WHEN 1 THEN greatest(y, '1996') || '-07-01' WHEN 3 THEN y || '-07-01' WHEN 5 THEN d[1:8] || '01'
           WHEN 6 THEN y || '-07-01' WHEN 7 THEN '2022-02-02' WHEN 9 THEN NULL
           WHEN 8 THEN greatest(d, '1994-01-01') ELSE d END AS date,
    CASE WHEN c = 1 AND y <> '1996' THEN least(y, '1996') || '–' || greatest(y, '1996')
         WHEN c = 7 THEN '2022' WHEN c = 9 THEN NULL ELSE y END AS date_span,
    CASE WHEN c <= 4 THEN 'high' WHEN c = 5 THEN 'medium' WHEN c < 9 THEN 'low' END AS date_confidence,
    c = 1 AND y <> '1996' AS mixed_era
  FROM dated_v)"""


@query(
    "date_assign_raw",
    with_views(DATED) + "SELECT path, date, date_span, date_confidence, mixed_era FROM assigned_v",
)
def date_assign_raw(spark, sf):
    return date_assignment.raw_dates(dated_notes(spark, sf).select("path", "content"))


@query(
    "date_statistics",
    with_views(DATED)
    + """SELECT 'raw' AS scope, coalesce(date_confidence, 'none') AS confidence, count(*) AS pages,
         count(*) FILTER (mixed_era) AS mixed_era FROM assigned_v GROUP BY ALL""",
)
def date_statistics(spark, sf):
    return date_assignment.statistics(date_assignment.raw_dates(dated_notes(spark, sf).select("path", "content")))


def citing_pages(spark, sf):
    """Customers as pages; their Sources sections cite notes, days, months or nothing."""
    key = F.col("c_custkey")
    lines = F.concat(
        F.when(key % 4 == 0, _cat("- [[Someone]] [[raw/", s(F.lit(1995) + key % 7), "/x|y]] seen\n")).otherwise(""),
        F.when(key % 3 == 0, "* mail of 12 March 1999, answered Apr 2003\n").otherwise(""),
        F.when(key % 5 == 0, "text without a bullet 1980-01-01\n- plain bullet 1997-05-06 and 2001\n").otherwise(""),
        F.when(key % 7 == 0, "*raw/notes/managed.md*\nraw/notes/low.md\n").otherwise(""),
    )
    name = F.when(key % 11 == 0, _cat("Plan 2002 ", s(key + 100000))).otherwise(_cat("Page ", s(key + 100000)))
    return table(spark, sf, "customer").select(
        _cat("wiki/people/", name, ".md").alias("path"),
        _cat("# T\n- before 1970-01-01\n## Sources\n", lines, "## Next\n- after 2020-01-01\n").alias("content"),
    )


_CITED = r"""
cited_v AS (
  SELECT c_custkey AS k, 'wiki/people/' || CASE WHEN c_custkey % 11 = 0 THEN 'Plan 2002 ' ELSE 'Page ' END
           || (c_custkey + 100000) || '.md' AS path FROM customer),
sources_v AS (
  SELECT path, (1995 + k % 7) || '-07-01' AS date, 3 AS r FROM cited_v WHERE k % 4 = 0
  UNION ALL SELECT path, '1999-03-01', 3 FROM cited_v WHERE k % 3 = 0
  UNION ALL SELECT path, '1997-05-06', 3 FROM cited_v WHERE k % 5 = 0
  UNION ALL SELECT path, '2010-10-10', 2 FROM cited_v WHERE k % 7 = 0
  UNION ALL SELECT path, '2010-10-10', 1 FROM cited_v WHERE k % 7 = 0),
page_dates_v AS (
  SELECT path, max(date) AS d, min(date) AS e, max(r) FILTER (date = m) AS r FROM (
    SELECT *, max(date) OVER (PARTITION BY path) AS m FROM sources_v) GROUP BY path)"""


@query(
    "date_assign_pages",
    with_views(_CITED)
    + """SELECT path, coalesce(d, t) AS date,
           CASE WHEN d IS NULL THEN t[1:4] WHEN d[1:4] = e[1:4] THEN d[1:4] ELSE e[1:4] || '–' || d[1:4] END AS date_span,
           CASE WHEN d IS NULL THEN CASE WHEN t IS NOT NULL THEN 'medium' END
                ELSE ['low', 'medium', 'high'][r] END AS date_confidence,
           coalesce(d[1:4] <> e[1:4], false) AS mixed_era
         FROM (SELECT *, CASE WHEN k % 11 = 0 THEN '2002-07-01' END AS t FROM cited_v LEFT JOIN page_dates_v USING (path))""",
)
def date_assign_pages(spark, sf):
    pages = citing_pages(spark, sf)
    cited = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") == 0, "raw/notes/managed.md").when(F.col("n_nationkey") == 1, "raw/notes/low.md")
        .otherwise(_cat("raw/notes/", F.col("n_name"), ".md")).alias("path"),
        F.when(F.col("n_nationkey") == 0, "---\ndate: 2010-10-10\ndate_confidence: medium\n---\nx")
        .otherwise("---\ncreated: 2010-10-10\n---\nx").alias("content"),
    )
    sources = date_assignment.page_source_dates(pages, date_assignment.date_fields(cited))
    return date_assignment.page_dates(pages, sources)


_SHORTENED = """
note_v AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, 'raw/mail/' || lpad(o_orderkey::VARCHAR, 9, '0') || ' m.md' AS path FROM orders),
line_v AS (
  SELECT 'wiki/people/c' || c_custkey || '.md' AS path, CASE c_custkey % 4 WHEN 0 THEN lpad((c_custkey * 7 // 10)::VARCHAR, 8, '0')
    WHEN 1 THEN lpad((c_custkey * 7 // 100)::VARCHAR, 7, '0') WHEN 2 THEN lpad((c_custkey * 7)::VARCHAR, 9, '0') || ' z' ELSE '' END AS start
  FROM customer)"""


@query(
    "date_assign_shortened",
    with_views(_SHORTENED)
    + """SELECT l.path, n.day AS date, 'high' AS date_confidence FROM line_v l
         JOIN (SELECT start, min(n.path) AS path FROM (SELECT DISTINCT start FROM line_v) s JOIN note_v n ON starts_with(n.path, 'raw/mail/' || start) GROUP BY start) f
           ON f.start = l.start JOIN note_v n ON n.path = f.path""",
)
def date_assign_shortened(spark, sf):
    """Pages that cite notes of one large folder by names cut short; a name stands for the first note that continues it."""
    key = F.col("c_custkey")
    digits = lambda c, n: F.lpad(s(c), n, "0")
    start = F.when(key % 4 == 0, digits(F.floor(key * 7 / 10), 8)).when(key % 4 == 1, digits(F.floor(key * 7 / 100), 7)).when(
        key % 4 == 2, _cat(digits(key * 7, 9), " z")
    ).otherwise("")
    pages = table(spark, sf, "customer").select(
        _cat("wiki/people/c", s(key), ".md").alias("path"), _cat("# T\n## Sources\n- seen in [[raw/mail/", start, "...|mail]]\n").alias("content")
    )
    notes = table(spark, sf, "orders").select(
        _cat("raw/mail/", digits(F.col("o_orderkey"), 9), " m.md").alias("path"),
        _cat("---\nsent: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\n---\nx").alias("content"),
    )
    found = date_assignment.page_source_dates(pages, date_assignment.date_fields(notes))
    return found.select("path", "date", F.col("confidence").alias("date_confidence"))


@query(
    "date_upsert_revert",
    with_views(DATED)
    + """SELECT path, '---' || chr(10) || 'kept: ' || o_orderkey || chr(10) || 'date: ' || date || chr(10)
           || 'date_span: ' || date_span || chr(10) || 'date_confidence: ' || date_confidence || chr(10)
           || '---' || chr(10) || 'Body.' AS updated,
           '---' || chr(10) || 'kept: ' || o_orderkey || chr(10) || '---' || chr(10) || 'Body.' AS reverted
         FROM assigned_v WHERE date IS NOT NULL""",
)
def date_upsert_revert(spark, sf):
    notes = dated_notes(spark, sf)
    # the dates are filtered and joined; finding them once is cheaper
    dated = checkpointed(date_assignment.raw_dates(notes.select("path", "content"))).where("date IS NOT NULL")
    texts = notes.select("path", _cat("---\ndate: old\nkept: ", s(F.col("o_orderkey")), "\nsource_span: x\n---\nBody.").alias("content"))
    rows = texts.join(dated, "path").select(
        "path", date_assignment.upserted(F.col("content"), F.col("date"), F.col("date_span"), F.col("date_confidence")).alias("updated")
    )
    return rows.select("path", "updated", date_assignment.reverted(F.col("updated")).alias("reverted"))


# supersession ----------------------------------------------------------------------------------
def superseding_pages(spark, sf):
    """Parts as pages that name successors: chains, rings of three, dangling and ambiguous names."""
    key = F.col("p_partkey")
    ring = F.when(key % 3 < 2, key + 1).otherwise(key - 2)
    block = F.floor(key / 30) % 3
    target = (
        F.when(block == 0, _cat("[[Part ", s(ring), "|next]]"))
        .when(key % 30 == 29, F.lit("nowhere"))
        .otherwise(_cat("Part ", s(key + 1)))
    )
    head = F.when(
        block < 2,
        F.when(key % 2 == 0, _cat("superseded_by: ", target, "\n"))
        .otherwise(_cat("superseded_by:\n  - ", target, "\n  - Twin\n")),
    ).otherwise("")
    back = F.when((block == 1) & (key % 5 > 0), _cat("supersedes: [[wiki/", projection.choose(projection.KINDS, (key - 1) % 8), "/Part ", s(key - 1), "]]\n")).otherwise("")
    prose = (
        F.when(key % 6 == 0, _cat("```\nrenamed to X\n```\n# Renamed to Y\nThe ", F.col("p_type"), " was replaced by [[Part ", s(key + 1), "|it]].\n"))
        .when(key % 6 == 1, "| cell | migrated to Z |\n`tag` renamed to `sha`\nNow decommissioned for good.\n")
        .when(key % 6 == 2, _cat("Old one superseded by part ", s(key), ".\n"))
        .otherwise("Nothing happened.\n")
    )
    return table(spark, sf, "part").select(
        projection.part_path(key).alias("path"), _cat("---\ntype: x\n", head, back, "---\n", prose).alias("content")
    )


SUPERSEDED = f"""
sp_v AS (SELECT p_partkey AS k, p_type, {KINDS}[p_partkey % 8 + 1] AS kind, (p_partkey // 30) % 3 AS b,
                CASE WHEN p_partkey % 3 < 2 THEN p_partkey + 1 ELSE p_partkey - 2 END AS ring FROM part),
name_v AS (SELECT *, 'wiki/' || kind || '/Part ' || k || '.md' AS path,
                  CASE WHEN b = 0 THEN ring WHEN k % 30 < 29 THEN k + 1 END AS nk FROM sp_v),
edge_v AS (SELECT a.k, a.path, t.k AS tk, t.path AS target FROM name_v a LEFT JOIN name_v t ON t.k = a.nk WHERE a.b < 2),
back_v AS (SELECT k, k - 1 AS old FROM name_v WHERE b = 1 AND k % 5 > 0)"""


def _supersession(spark, sf):
    pages = superseding_pages(spark, sf)
    forward = supersession.resolve(supersession.declared(pages, "superseded_by"), pages)
    back = supersession.resolve(supersession.declared(pages, "supersedes"), pages)
    return pages, forward, back


@query(
    "supersession_integrity",
    with_views(SUPERSEDED)
    + """SELECT path, target AS resolved FROM edge_v e WHERE target IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM back_v b WHERE b.k = e.tk AND b.old = e.k)""",
)
def supersession_integrity(spark, sf):
    _, forward, back = _supersession(spark, sf)
    return supersession.missing_reciprocal(forward, back)


@query(
    "supersession_targets",
    with_views(SUPERSEDED)
    + """SELECT path, CAST(0 AS BIGINT) AS position, CASE WHEN target IS NULL THEN 'dangling' ELSE 'resolved' END AS outcome,
           target AS resolved FROM edge_v
         UNION ALL SELECT path, 1, 'dangling', NULL FROM edge_v WHERE k % 2 = 1""",
)
def supersession_targets(spark, sf):
    _, forward, _ = _supersession(spark, sf)
    return forward.select("path", F.col("position").cast("bigint").alias("position"), "outcome", "resolved")


@query(
    "supersession_cycles",
    with_views(SUPERSEDED)
    + """SELECT a.path, a.path || ' -> ' || b.path || ' -> ' || c.path || ' -> ' || a.path AS cycle
         FROM edge_v a JOIN edge_v b ON b.k = a.tk JOIN edge_v c ON c.k = b.tk WHERE c.tk = a.k""",
)
def supersession_cycles(spark, sf):
    return supersession.cycles(_supersession(spark, sf)[1])


@query(
    "supersession_counters",
    with_views(SUPERSEDED)
    + """SELECT (SELECT count(*) FROM edge_v) AS pages_superseded, (SELECT count(*) FROM back_v) AS pages_superseding,
           (SELECT count(*) FILTER (target IS NULL) + count(*) FILTER (k % 2 = 1) FROM edge_v) AS dangling,
           CAST(0 AS BIGINT) AS ambiguous,
           (SELECT count(*) FROM edge_v e WHERE target IS NOT NULL AND NOT EXISTS
             (SELECT 1 FROM back_v b WHERE b.k = e.tk AND b.old = e.k)) AS missing_reciprocal,
           (SELECT count(*) FROM edge_v a JOIN edge_v b ON b.k = a.tk JOIN edge_v c ON c.k = b.tk
            WHERE c.tk = a.k) AS cycles""",
)
def supersession_counters(spark, sf):
    _, forward, back = _supersession(spark, sf)
    return supersession.counters(forward, back)


@query(
    "supersession_queue",
    with_views(SUPERSEDED)
    + """SELECT path, kind AS topic, CASE k % 6 WHEN 0 THEN 'replaced by' ELSE 'decommissioned' END AS phrase,
           CASE k % 6 WHEN 0 THEN 'Part ' || (k + 1) ELSE '' END AS guess,
           CASE k % 6 WHEN 0 THEN 'The ' || p_type || ' was replaced by [[Part ' || (k + 1) || '|it]].'
                ELSE 'Now decommissioned for good.' END AS context
         FROM name_v WHERE b = 2 AND k % 6 < 2""",
)
def supersession_queue(spark, sf):
    pages, forward, _ = _supersession(spark, sf)
    found = supersession.without_self_guesses(supersession.body_candidates(pages, forward), pages)
    return found.orderBy(*supersession.queue_order()).select("path", "topic", "phrase", "guess", "context")


# mapping ---------------------------------------------------------------------------------------
@query(
    "search_hit_resolution",
    with_views(PAGES)
    + """SELECT o_orderkey AS rank, CASE WHEN pk IS NULL THEN 'unresolved' ELSE 'wiki' END AS family, path,
           coalesce(o_orderkey = min(o_orderkey) OVER (PARTITION BY path), false) AND path IS NOT NULL AS first
         FROM orders LEFT JOIN (SELECT part_key AS pk, path FROM pages_v) ON pk = o_custkey AND o_orderkey % 3 < 2""",
)
def search_hit_resolution(spark, sf):
    """Orders as ranked hits on part pages: scheme ids, plain paths, ids of another collection."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    kind = projection.choose(projection.KINDS, customer % 8)
    slug = _cat("notes://vault/wiki/", kind, "/part-", s(customer), ".md")
    hit = F.when(key % 3 == 0, slug).when(key % 3 == 1, _cat("./", projection.part_path(customer))).otherwise(
        _cat("notes://other/wiki/", kind, "/Part ", s(customer), ".md")
    )
    hits = table(spark, sf, "orders").select(key.alias("rank"), hit.alias("id"))
    pages, notes = projection.pages(spark, sf), projection.raw_notes(spark, sf)
    found = mapping.resolve_hits(hits, pages, notes, "notes", "vault")
    return found.select("rank", "family", "path", "first")


@query(
    "raw_to_page_mapping",
    with_views(PAGES)
    + """, keys_v AS (SELECT key, min(path) AS page FROM (
             SELECT lower(trim(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) AS key, path FROM pages_v
             UNION ALL SELECT 'part ' || part_key, path FROM pages_v) GROUP BY key HAVING min(path) = max(path)),
         wanted_v AS (SELECT o_orderkey, 'part ' || o_custkey AS key, 'wikilink' AS reason FROM orders WHERE o_orderkey % 3 > 0
             UNION SELECT o_orderkey, 'part ' || (o_orderkey // 4), 'title-match' FROM orders WHERE o_orderkey % 4 = 0)
         SELECT 'raw/notes/n' || o_orderkey || '.md' AS note, page, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons
         FROM wanted_v JOIN keys_v USING (key) GROUP BY ALL""",
)
def raw_to_page_mapping(spark, sf):
    return mapping.map_notes(mapped_notes(spark, sf), projection.pages(spark, sf)).select(
        "note", "page", F.array_join("reasons", "|").alias("reasons")
    )


def mapped_notes(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        _cat("raw/notes/n", s(key), ".md").alias("path"),
        F.when(key % 4 == 0, _cat("2024-01-02 Mail - Part ", s(F.floor(key / 4)), ".docx")).otherwise("Untitled").alias("title"),
        F.when(key % 3 == 0, "no link").when(key % 3 == 1, _cat("x [[wiki/a/Part ", s(F.col("o_custkey")), ".md#h|y]]"))
        .otherwise(_cat("x [[part-", s(F.col("o_custkey")), "]]")).alias("content"),
    )


@query(
    "raw_evidence",
    with_views(PAGES)
    + """SELECT 'raw/notes/n' || o_orderkey || '.md' AS path FROM orders
         WHERE (o_orderkey % 3 = 0 OR o_custkey NOT IN (SELECT part_key FROM pages_v))
           AND (o_orderkey % 4 > 0 OR o_orderkey // 4 NOT IN (SELECT part_key FROM pages_v))""",
)
def raw_evidence(spark, sf):
    notes = mapped_notes(spark, sf)
    return mapping.unmapped_notes(notes, mapping.map_notes(notes, projection.pages(spark, sf))).select("path")


# packet from search hits -------------------------------------------------------------------------
_HIT_VIEWS = """, keys_v AS (SELECT key, min(path) AS page FROM (
    SELECT lower(trim(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'))) AS key, path FROM pages_v
    UNION ALL SELECT 'part ' || part_key, path FROM pages_v) GROUP BY key HAVING min(path) = max(path)),
  hits_v AS (
    SELECT o_orderkey AS rank, CASE WHEN o_orderkey % 5 = 3 THEN 'raw' WHEN o_orderkey % 5 < 3 AND path IS NOT NULL THEN 'wiki'
        ELSE 'unresolved' END AS family, o_custkey, path
    FROM orders LEFT JOIN pages_v ON part_key = o_custkey),
  mapped_v AS (
    SELECT DISTINCT rank, page FROM (
      SELECT rank, 'part ' || o_custkey AS key FROM hits_v WHERE family = 'raw' AND rank % 3 > 0
      UNION ALL SELECT rank, 'part ' || (rank // 4) FROM hits_v WHERE family = 'raw' AND rank % 4 = 0) JOIN keys_v USING (key)),
  named_v AS (
    SELECT path, 0 AS source, part_key - 1 AS rank FROM pages_v WHERE part_key <= 3
    UNION ALL SELECT path, 1, rank FROM hits_v WHERE family = 'wiki'
    UNION ALL SELECT page, 2, rank FROM mapped_v),
  candidates_v AS (
    SELECT path, min(source) AS source, min_by(rank, source * 1000000000000 + rank) AS rank FROM named_v GROUP BY path)
"""


def _hit_packet(spark, sf):
    """Orders as ranked hits: pages, raw notes, and names that mean nothing; three pages are asked for by name."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    hit = F.when(key % 5 == 3, _cat("notes://vault/raw/notes/n", s(key), ".md")).when(key % 5 < 3, projection.part_path(customer)).otherwise(
        _cat("notes://vault/wiki/none/", s(key), ".md")
    )
    pages, notes = projection.pages(spark, sf), mapped_notes(spark, sf)
    hits = mapping.resolve_hits(table(spark, sf, "orders").select(key.alias("rank"), hit.alias("id")), pages, notes, "notes", "vault")
    requested = pages.where("part_key <= 3").select((F.col("part_key") - 1).alias("ordinal"), F.col("path").alias("page"))
    return freshness.hit_packet(
        freshness_queries.state(spark, sf), projection.block_facts(spark, sf), freshness_queries.QUESTIONS["current"], hits, notes,
        requested, limit=freshness_queries.TOP,
    )


@query("packet_candidates", with_views(PAGES) + _HIT_VIEWS + "SELECT path, source, rank FROM candidates_v")
def packet_candidates(spark, sf):
    found = _hit_packet(spark, sf)["candidate_pages"]
    return found.select("path", F.col("ordinal.source").alias("source"), F.col("ordinal.rank").alias("rank"))


@query(
    "packet_blocks",
    with_views(PAGES, BLOCKS) + _HIT_VIEWS
    + f"""SELECT * FROM (SELECT row_number() OVER (ORDER BY freshness_score DESC, m DESC, id, path, ordinal) AS rank, path, id, freshness_score
          FROM (SELECT b.*, {score_case("current")} AS freshness_score, {MONTH} AS m
                FROM blocks_v b JOIN candidates_v USING (path))) WHERE rank <= {freshness_queries.TOP}""",
)
def packet_blocks(spark, sf):
    found = _hit_packet(spark, sf)["ranked_blocks"]
    return found.select(F.col("rank").cast("bigint").alias("rank"), "path", "id", "freshness_score")


@query(
    "packet_evidence",
    with_views(PAGES) + _HIT_VIEWS
    + """SELECT 'raw/notes/n' || rank || '.md' AS id, 'evidence' AS kind FROM hits_v
           WHERE family = 'raw' AND rank NOT IN (SELECT rank FROM mapped_v)
         UNION ALL SELECT CASE WHEN rank % 5 = 4 THEN 'notes://vault/wiki/none/' || rank || '.md'
           ELSE 'wiki/' || """ + KINDS + """[o_custkey % 8 + 1] || '/Part ' || o_custkey || '.md' END, 'unresolved' FROM hits_v
           WHERE family = 'unresolved'""",
)
def packet_evidence(spark, sf):
    packet = _hit_packet(spark, sf)
    return packet["raw_evidence"].select(F.col("path").alias("id"), F.lit("evidence").alias("kind")).unionByName(
        packet["unresolved"].select("id", F.lit("unresolved").alias("kind"))
    )


# retrieval -------------------------------------------------------------------------------------
_TERMS = ["and", "la", "of", "und"]


@query(
    "bm25_topk",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS toks FROM documents),
      l AS (SELECT doc_id, len(toks) AS len, unnest({_TERMS}) AS term, toks FROM t),
      f AS (SELECT doc_id, len, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM l),
      st AS (SELECT count(*) AS n, avg(len(toks)) AS av FROM t),
      df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term)
      SELECT doc_id, round(sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
        / (tf + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END), 6) AS score
      FROM f JOIN df USING (term) CROSS JOIN st GROUP BY doc_id HAVING score > 0 ORDER BY score DESC, doc_id LIMIT 15""",
)
def bm25_topk(spark, sf):
    return retrieval.bm25(table(spark, sf, "documents"), "doc_id", "text", ", ".join(_TERMS).upper() + "?")


@query(
    "lexical_index",
    """SELECT doc_id, len(toks) AS doc_length, term, count(*) AS tf FROM (
         SELECT doc_id, toks, unnest(toks) AS term FROM (
           SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS toks FROM documents)) GROUP BY ALL""",
)
def lexical_index(spark, sf):
    return retrieval.lexical_index(table(spark, sf, "documents"), "doc_id", "text").withColumn(
        "doc_length", F.col("doc_length").cast("bigint")
    )


@query(
    "semantic_topk",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
         (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS similarity
       FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 15""",
)
def semantic_topk(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id = 0").select("embedding").scalar()
    return retrieval.nearest(vectors, "vec_id", "embedding", asked)


# transcripts -----------------------------------------------------------------------------------
def cue_rows(spark, sf):
    """Conversation turns as cues; every seventh turn follows a pause."""
    turn = F.col("turn")
    start = turn * 10.0 + F.floor(turn / 7) * 200.0
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file"), turn.alias("pos"), start.alias("start"),
        (start + F.when(turn % 3 == 0, 9.0).otherwise(5.0)).alias("end"),
        F.when(turn % 5 == 4, "").otherwise(_cat("Speaker ", s(F.floor(turn / 2) % 2))).alias("speaker"),
        F.col("text"),
    )


CUES = """
cue_v AS (
  SELECT conv_id AS file, turn AS pos, turn * 10.0 + (turn // 7) * 200.0 AS s,
         turn * 10.0 + (turn // 7) * 200.0 + CASE WHEN turn % 3 = 0 THEN 9.0 ELSE 5.0 END AS e,
         CASE WHEN turn % 5 = 4 THEN '' ELSE 'Speaker ' || ((turn // 2) % 2) END AS speaker, text FROM conversations),
lag_v AS (SELECT *, lag(speaker) OVER w AS ls, lag(e) OVER w AS le FROM cue_v WINDOW w AS (PARTITION BY file ORDER BY pos)),
isl_v AS (SELECT *, max(CASE WHEN ls IS NULL OR ls <> speaker OR s - le > 120 THEN pos END)
          OVER (PARTITION BY file ORDER BY pos) AS block FROM lag_v),
block_v AS (SELECT file, block, any_value(speaker) AS speaker, CAST(min(s) AS DOUBLE) AS start, CAST(max_by(e, pos) AS DOUBLE) AS "end",
            count(*) AS cues FROM isl_v GROUP BY ALL)"""


@query(
    "cue_merge",
    with_views(CUES)
    + """SELECT file, block, speaker, start, "end", cues,
           coalesce(start - lag("end") OVER (PARTITION BY file ORDER BY block) >= 120, false) AS timed FROM block_v""",
)
def cue_merge(spark, sf):
    rows = transcripts.blocks(cue_rows(spark, sf))
    return rows.select("file", "block", "speaker", "start", "end", F.col("cues").cast("bigint").alias("cues"), "timed")


@query(
    "cue_paragraphs",
    with_views(CUES).replace("WITH", "WITH RECURSIVE", 1)
    + """, order_v AS (SELECT file, block, s, e, text, row_number() OVER (PARTITION BY file, block ORDER BY pos) AS n FROM isl_v),
    fold_v AS (
      SELECT file, block, n, text AS open, e, CAST(0 AS BIGINT) AS "at" FROM order_v WHERE n = 1
      UNION ALL
      SELECT file, block, n, CASE WHEN joins THEN before || ' ' || text ELSE text END, e, "at" + CASE WHEN joins THEN 0 ELSE 1 END
      FROM (SELECT o.*, f."at", f.open AS before, NOT ends_with(f.open, '.')
              OR (o.s - f.e < 3 AND length(f.open) + 1 + length(o.text) <= 500) AS joins
            FROM fold_v f JOIN order_v o ON o.file = f.file AND o.block = f.block AND o.n = f.n + 1))
    SELECT file, block, "at", max_by(open, n) AS paragraph FROM fold_v GROUP BY ALL""",
)
def cue_paragraphs(spark, sf):
    return transcripts.paragraph_rows(cue_rows(spark, sf)).select("file", "block", F.col("at").cast("bigint").alias("at"), "paragraph")


@query(
    "cue_overview",
    with_views(CUES)
    + """, sp_v AS (SELECT file, speaker, min(pos) AS p FROM cue_v WHERE speaker <> '' GROUP BY ALL),
    d_v AS (SELECT file, CAST(floor(max_by(e, pos)) AS BIGINT) AS t FROM cue_v GROUP BY file)
    SELECT file, coalesce((SELECT string_agg(speaker, '|' ORDER BY p) FROM sp_v WHERE sp_v.file = d_v.file), '') AS speakers,
      (t // 3600) || ':' || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS duration
    FROM d_v""",
)
def cue_overview(spark, sf):
    return transcripts.overview(cue_rows(spark, sf)).select("file", F.array_join("speakers", "|").alias("speakers"), "duration")


@query(
    "cue_parse_roundtrip",
    r"""SELECT conv_id AS file, CAST(turn * 10.25 AS DOUBLE) AS start, CAST(turn * 10.25 + 3661.5 AS DOUBLE) AS "end",
          CASE turn % 3 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN role ELSE '' END AS speaker, 'Line ' || turn || ' of talk.' AS text
        FROM conversations""",
)
def cue_parse_roundtrip(spark, sf):
    """One caption file per turn: header, note, identifier, timing, voice tag or name with colon."""
    def stamp(t):
        whole = F.floor(t).cast("bigint")
        return F.format_string(
            "%02d:%02d:%02d.%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60,
            F.round((t - whole) * 1000).cast("bigint"),
        )

    turn = F.col("turn")
    start = turn * 10.25
    lead = F.when(turn % 3 == 0, "<v Ann Lee>").when(turn % 3 == 1, _cat(F.col("role"), ": ")).otherwise("")
    content = _cat(
        "WEBVTT\nKind: captions\n\nNOTE made\n00:00:01.000 --> 00:00:02.000\nnot text\n\n", s(turn), "\n", stamp(start), " --> ",
        stamp(start + 3661.5), " align:start\n", lead, "Line ", s(turn), "\n of <i>talk</i>.\n\n",
    )
    files = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), content.alias("content"))
    return transcripts.parse_cues(files).select("file", "start", "end", "speaker", "text")


# mail ------------------------------------------------------------------------------------------
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("html_strip", f"SELECT page_id, {_STRIPPED} AS body FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", mail.html_text(F.col("html")).alias("body"))


@query(
    "mail_header_parse",
    f"""SELECT 'm' || page_id AS path, page_id % 4 > 0 AS structured,
          CASE WHEN page_id % 4 = 0 OR page_id % 5 = 0 THEN '(unknown sender)' ELSE 'a' || page_id || '@x.org' END AS "from",
          CASE WHEN page_id % 4 = 0 THEN '(unknown recipient)' ELSE 'b@x.org, c@x.org' END AS "to",
          CASE WHEN page_id % 4 > 0 AND page_id % 3 = 0 THEN 'd@x.org' ELSE '' END AS cc, '' AS bcc,
          CASE WHEN page_id % 4 = 0 THEN '(no subject)' ELSE 'About ' || url END AS subject, {_STRIPPED} AS body
        FROM pages""",
)
def mail_header_parse(spark, sf):
    key = F.col("page_id")
    header = _cat(
        "FROM:", F.when(key % 5 == 0, "").otherwise(_cat("a", s(key), "@x.org")), F.when(key % 2 == 0, ";").otherwise(","),
        "TO:", F.when(key % 2 == 0, "b@x.org; c@x.org;").otherwise("b@x.org,c@x.org"),
        F.when(key % 3 == 0, ",CC: d@x.org").otherwise(""), ",SUBJECT: About ", F.col("url"), " ,BODY:",
    )
    files = table(spark, sf, "pages").select(
        _cat("m", s(key)).alias("path"), _cat(F.when(key % 4 == 0, "").otherwise(header), F.col("html")).alias("content")
    )
    return mail.parse_exports(files)


@query(
    "mail_message_parse",
    r"""SELECT 'm' || conv_id || '-' || turn AS path,
          CASE WHEN turn % 3 = 2 THEN '1970-01-02' ELSE '2024-05-0' || (turn % 3 + 1) END AS date,
          CASE turn % 3 WHEN 0 THEN 'Date header' WHEN 1 THEN 'Received header' ELSE 'file time' END AS date_source,
          role || '@x.org' AS "from", '(unknown recipient)' AS "to", 'Größe ' || turn AS subject,
          CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE 'Bold ' || turn END AS body,
          CASE WHEN turn % 2 = 0 THEN 'text/plain' ELSE 'text/html' END AS body_source
        FROM conversations""",
)
def mail_message_parse(spark, sf):
    turn = F.col("turn")
    when = F.when(turn % 3 == 0, "Date: Wed, 01 May 2024 10:00:00 +0200\n").when(
        turn % 3 == 1, "Received: from a by b; Thu, 02 May 2024 10:00:00 +0000\n"
    ).otherwise("")
    subject = _cat("Subject: =?utf-8?q?Gr=C3=B6=C3=9Fe?= ", s(turn), "\n")
    body = F.when(
        turn % 2 == 0,
        _cat("MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=ZZZ\n\n--ZZZ\nContent-Type: text/plain; charset=utf-8\n"
             "Content-Transfer-Encoding: base64\n\n", F.base64(F.encode("text", "utf-8")),
             "\n--ZZZ\nContent-Type: text/html\n\n<p>no</p>\n--ZZZ\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--ZZZ--\n"),
    ).otherwise(_cat("Content-Type: text/html; charset=utf-8\n\n<b>Bold</b> ", s(turn), "\n"))
    files = table(spark, sf, "conversations").select(
        _cat("m", s(F.col("conv_id")), "-", s(turn)).alias("path"), F.lit(86400).alias("mtime"),
        F.encode(_cat("From: ", F.col("role"), "@x.org\n", when, subject, body), "utf-8").alias("content"),
    )
    return mail.parse_messages(files).select("path", "date", "date_source", "from", "to", "subject", "body", "body_source")


# indexes ---------------------------------------------------------------------------------------
@query(
    "topic_index",
    f"""SELECT kind AS topic, path, '- [[wiki/' || kind || '/doc ' || doc_id || '|' ||
          CASE WHEN doc_id % 3 = 0 THEN 'doc ' || doc_id ELSE 'Title ' || doc_id END || ']] — ' ||
          CASE WHEN doc_id % 3 = 0 THEN 'No summary available.' WHEN doc_id % 3 = 1 THEN 'First one.' ELSE 'No stop here' END AS line
        FROM (SELECT *, {KINDS}[doc_id % 8 + 1] AS kind, 'wiki/' || {KINDS}[doc_id % 8 + 1] || '/doc ' || doc_id || '.md' AS path
              FROM documents)""",
)
def topic_index(spark, sf):
    key = F.col("doc_id")
    kind = projection.choose(projection.KINDS, key % 8)
    head = F.when(key % 3 == 0, "---\ntype: x\n---\n").when(key % 3 == 1, _cat("## Title ", s(key), "\n\nFirst one. Second.\n")).otherwise(
        _cat("---\na: b\n---\nlead\n# Title ", s(key), "\n### More\nNo stop here\n")
    )
    pages = table(spark, sf, "documents").select(
        _cat("wiki/", kind, "/doc ", s(key), ".md").alias("path"),
        _cat(head, F.regexp_replace("text", "#", "")).alias("content"),
    )
    return topics.index_entries(pages)


# plain semi and anti joins ---------------------------------------------------------------------
@query(
    "quality_filter_join",
    "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
)
def quality_filter_join(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    return table(spark, sf, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("contamination_anti_join", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def contamination_anti_join(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "benchmark").select("text").distinct(), "text", "left_anti").select("doc_id")


@query(
    "contamination_runs",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      b AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run
            FROM (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark)),
      r AS (SELECT DISTINCT doc_id FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS run FROM w) JOIN b USING (run))
      SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM r)""",
)
def contamination_runs(spark, sf):
    """Documents without any run of 13 words of a benchmark item."""
    docs = table(spark, sf, "documents")
    found = contamination.holders(docs, "doc_id", "text", table(spark, sf, "benchmark"), "text")
    return docs.select("doc_id").join(found, "doc_id", "left_anti")
