"""Rewrites, stamps, reports, moves and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.skew import shuffled
from ..operators import coverage, edits, ledger, relocation, rewrite, stamping
from ..session import checkpoint_folder
from ..sinks import reports
from ..sources import ledger as log_source
from ..sources.tables import table
from ..streaming import ingest as stream_ingest_module
from ..streaming import ledger as stream_ledger
from ..streaming import sessions as stream_sessions
from . import documents_vault, projection
from .freshness_queries import _PRIORITY, _STATE_VIEWS, drift_rows, state
from .freshness_queries import _DRIFT_VIEWS
from .ingest_queries import DOCS
from .registry import query
from .text_vault import _cat, s
from .vault_sql import with_views


#: Lines of a log file, about.
LINES_A_FILE = 100_000


def linked_text(spark, sf):
    """Orders as notes with one link of each spelling."""
    key = s(F.col("o_custkey"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), _cat("Part (", key, ")").alias("target"),
        _cat("a [[Part (", key, ")]] b [[Part (", key, ")|alias]] c [[Part (", key, ") #h]] d\n- [[Part (", key,
             ")]]\n![[Part (", key, ")]] [t](Part (", key, ")#x) [](Part (", key, "))\nend").alias("content"),
    )


_T = "'Part (' || o_custkey || ')'"


@query(
    "rewrite_links",
    f"""SELECT o_orderkey AS key,
      'a [[N$1]] b [[N$1|alias]] c [[N$1 #h]] d' || chr(10) || '- [[N$1]]' || chr(10) || '![[' || t || ']] [t](' || t
        || '#x) [](' || t || ')' || chr(10) || 'end' AS replaced,
      'a [[' || t || '|(broken link) ' || t || ']] b [[' || t || '|(broken link) alias]] c [[' || t || ' #h|(broken link) '
        || t || ']] d' || chr(10) || '- [[' || t || '|(broken link) ' || t || ']]' || chr(10) || '![[' || t || ']] [t](' || t
        || '#x) [](' || t || ')' || chr(10) || 'end' AS marked,
      'a ' || t || ' b alias c ' || t || ' d' || chr(10) || '- ' || t || chr(10) || '![[' || t || ']] [t](' || t
        || '#x) [](' || t || ')' || chr(10) || 'end' AS plain,
      'a b c d' || chr(10) || '![[' || t || ']] [t](' || t || '#x) [](' || t || ')' || chr(10) || 'end' AS deleted,
      'a [[' || t || ']] b [[' || t || '|alias]] c [[' || t || ' #h]] d' || chr(10) || '- [[' || t || ']]' || chr(10)
        || '![[' || t || ']] t ' || t || chr(10) || 'end' AS md_plain,
      'a [[broken-link|' || t || ']] b [[broken-link|alias]] c [[broken-link|' || t || ']] d' || chr(10) || '- [[broken-link|'
        || t || ']]' || chr(10) || '![[' || t || ']] [t](' || t || '#x) [](' || t || ')' || chr(10) || 'end' AS parked
    FROM (SELECT *, {_T} AS t FROM orders)""",
)
def rewrite_links(spark, sf):
    notes, c, t = linked_text(spark, sf), F.col("content"), F.col("target")
    return notes.select(
        "key", rewrite.replaced_wikilink(c, t, F.lit("N$1")).alias("replaced"),
        rewrite.marked_broken(c, t).alias("marked"), rewrite.delinked_wikilink(c, t).alias("plain"),
        rewrite.deleted_wikilink(c, t).alias("deleted"), rewrite.delinked_mdlink(c, t).alias("md_plain"),
        rewrite.placeholder(c, t).alias("parked"),
    )


@query(
    "rewrite_raw_references",
    r"""SELECT o_orderkey AS key, '---' || chr(10) || 'source: `' || p || '`' || chr(10) || '---' || chr(10)
          || 'see [[' || p || ']] ok' || chr(10) || '- [[' || p || ']] tail' || chr(10) || 'Source: [[' || p || ']]' || chr(10)
          || '```' || chr(10) || '~~~' || chr(10) || '- ' || p || chr(10) || '```' || chr(10) || 'text ' || p AS content
        FROM (SELECT *, 'raw/n ' || o_orderkey || '.md' AS p FROM orders)""",
)
def rewrite_raw_references(spark, sf):
    p = _cat("raw/n ", s(F.col("o_orderkey")), ".md")
    notes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"),
        _cat("---\nsource: `", p, "`\n---\nsee `", p, "` ok\n- ", p, " tail\nSource: ", p, "\n```\n~~~\n- ", p, "\n```\ntext ", p).alias("content"),
    )
    return notes.select("key", rewrite.wrapped_raw_references(F.col("content")).alias("content"))


_MODES = list(vocab.STAMP_TEXT)


def _sentence_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN '{vocab.STAMP_TEXT[m].replace(chr(39), chr(39) * 2)}'" for i, m in enumerate(_MODES))
    return f"CASE doc_id % {len(_MODES)} {cases} END"


@query(
    "minimal_stamp",
    rf"""WITH d AS (
           SELECT doc_id, 'wiki/people/d' || doc_id || '.md' AS page, doc_id % 5 > 0 AS fresh,
             CASE WHEN doc_id % 3 = 0 THEN 'freshness-status-3' ELSE 'freshness-status' END AS id,
             [{", ".join(f"'{m}'" for m in _MODES)}][doc_id % {len(_MODES)} + 1] AS mode, {_sentence_sql()} AS sentence,
             CASE WHEN doc_id % 3 = 0 THEN 'x ^freshness-status' || chr(10) || 'y ^freshness-status-2' || chr(10) ELSE '' END
               || replace(text, '^', '') AS rest FROM documents)
         SELECT page, CASE WHEN fresh THEN 'stamped' ELSE 'skipped' END AS action, CASE WHEN fresh THEN id END AS block_id,
           CASE WHEN fresh THEN mode END AS mode,
           CASE WHEN fresh THEN md5(regexp_replace(
             '---' || chr(10) || 'a: b' || chr(10) || '---' || chr(10) || '# Title' || chr(10) || chr(10) || '## Freshness Status' || chr(10)
             || chr(10) || sentence || ' ^' || id || chr(10) || chr(10) || rest, '\s+$', '')
             || chr(10) || chr(10) || '> [!provenance]- Provenance' || chr(10) || '> schema: kb-prov-v1' || chr(10)
             || '> migration_status: {vocab.MINIMAL_MIGRATION}' || chr(10) || '> blocks:' || chr(10) || '>   ' || id || ':' || chr(10)
             || '>     sources: ["raw/a.md"]' || chr(10) || '>     checked: 2024-06-01' || chr(10) || '>     status: current' || chr(10)
             || '>     confidence: medium' || chr(10) || '>     provenance_quality: {vocab.MINIMAL_QUALITY}' || chr(10)
             || '>     scope: page-level caution only; detailed claims not yet block-mapped' || chr(10)
             || '>     review_mode: ' || mode || chr(10) || '>     evidence_latest: 2024-01-01' || chr(10) || '>     review_note: why'
             || chr(10)) END AS content_md5 FROM d""",
)
def minimal_stamp(spark, sf):
    """Every mode; the whole stamped text is compared by its digest."""
    key = F.col("doc_id")
    pages = table(spark, sf, "documents").select(
        key, _cat("wiki/people/d", s(key), ".md").alias("path"),
        _cat("---\na: b\n---\n# Title\n", F.when(key % 3 == 0, "x ^freshness-status\ny ^freshness-status-2\n").otherwise(""),
             F.regexp_replace("text", r"\^", ""), F.when(key % 5 == 0, "\n> [!provenance]\n> schema: kb-prov-v1\n").otherwise("")).alias("content"),
    )
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (key % len(_MODES) + 1).cast("int"))
    requests = stamping.specs(
        pages.select(
            F.col("path").alias("page"), mode.alias("stamp_mode"), F.lit(None).cast("string").alias("mode"),
            F.lit("why").alias("reason"), F.array(F.lit("raw/a.md")).alias("sources"),
            F.lit(None).cast("array<string>").alias("related_raw"), F.lit("2024-01-01").alias("latest_related_raw_date"),
        )
    )
    out = stamping.stamp(requests, pages.drop("doc_id"), "2024-06-01")
    return out.select("page", "action", "block_id", "mode", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "plain_reference_links",
    r"""SELECT doc_id AS key, md5(array_to_string(list_transform(
          regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+'),
          lambda w: CASE WHEN w = 'the' THEN '[[the]]' ELSE w END), '')) AS content_md5 FROM documents""",
)
def plain_reference_links(spark, sf):
    """Mentions of one page in whole documents made links."""
    linked = rewrite.plain_references_linked(F.col("text"), F.lit("the"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.md5(linked.cast("binary")).alias("content_md5"))


@query(
    "log_prune_many_files",
    """SELECT 'raw/u' || user_id || '.md' AS file,
         max_by(CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d') || (CASE WHEN event_id % 2 = 1 THEN 'a' ELSE 'b' END)
           || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS summary, count(*) AS entries
       FROM events GROUP BY ALL""",
)
def log_prune_many_files(spark, sf):
    """Two log folders of many files; of one day the entry of the later argument, then the later line, is the latest."""
    events, work = table(spark, sf, "events"), _work_folder(spark)
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), _cat("raw/u", s(F.col("user_id")), ".md").alias("file"), s(F.col("event_id")).alias("summary")
    ))
    folders = []
    # many files, and no more lines in one than a task sorts at ease
    files = max(7, -(-events.count() // (2 * LINES_A_FILE)))
    for odd in (1, 0):
        folders.append(f"{work}/{odd}")
        part = events.where(F.col("event_id") % 2 == odd).repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
        part.select(line.alias("value")).write.text(folders[-1])
    log = log_source.read(spark, *folders)
    existing = events.select(_cat("raw/u", s(F.col("user_id")), ".md").alias("path")).distinct()
    return ledger.prune(log, existing).select("file", "summary", "entries")


@query(
    "report_drift_queue",
    with_views(*_DRIFT_VIEWS)
    + """SELECT '- [ ] **[[' || regexp_replace(page, '\\.md$', '') || ']]** score ' || score || ' — ' || replace(reasons, '|', ', ') AS line FROM drift_v
         UNION ALL SELECT '      <sub>latest related raw: ' || coalesce(latest_related_raw_date, '?') || '; checked: '
           || coalesce(checked, '?') || '; related raw notes: ' || related_raw_count || '</sub>' FROM drift_v""".replace("\\\\", "\\"),
)
def report_drift_queue(spark, sf):
    return reports.drift_queue(drift_rows(spark, sf)).orderBy("section", "key", "at").select("line")


@query(
    "report_coverage_backlog",
    with_views(*_STATE_VIEWS)
    + f"""SELECT '- [ ] **[[' || path[1:-4] || ']]** `' || coverage_status || '` priority ' || {_PRIORITY} AS line
            FROM covered_v WHERE coverage_status <> 'covered'
          UNION ALL SELECT '- ' || coverage_status || ': ' || count(*) FROM covered_v GROUP BY coverage_status
          UNION ALL SELECT '      <sub>kind: ' || kind || '; blocks: ' || block_count || '</sub>'
            FROM covered_v WHERE coverage_status <> 'covered'""",
)
def report_coverage_backlog(spark, sf):
    pages = state(spark, sf)
    report = reports.status_counts(coverage.with_status(pages)).unionByName(reports.coverage_backlog(coverage.backlog(pages)))
    return report.orderBy("section", "key", "at").select("line")


@query(
    "loose_file_moves",
    """SELECT 'raw/clips/p' || page_id || '.pdf' AS old,
         'raw/clips/_resources/p' || page_id || CASE WHEN page_id % 3 = 0 THEN ' 2' WHEN page_id % 3 = 1 THEN ' 3' ELSE '' END || '.pdf' AS new,
         page_id % 3 = 2 AND page_id % 2 = 0 AS note_exists FROM pages""",
)
def loose_file_moves(spark, sf):
    pages, key = table(spark, sf, "pages"), s(F.col("page_id"))
    loose = pages.select(_cat("raw/clips/p", key, ".pdf").alias("path"))
    there = pages.select(
        F.explode(
            F.filter(
                F.array(
                    F.when(F.col("page_id") % 3 < 2, _cat("raw/clips/_resources/p", key, ".pdf")),
                    F.when(F.col("page_id") % 3 == 1, _cat("raw/clips/_resources/p", key, " 2.pdf")),
                    F.when(F.col("page_id") % 2 == 0, _cat("raw/clips/p", key, ".md")),
                ),
                lambda p: p.isNotNull(),
            )
        ).alias("path")
    )
    return relocation.loose_file_moves(loose, loose.unionByName(there)).select("old", "new", "note_exists")


@query(
    "moved_link_targets",
    """SELECT DISTINCT 'p' || o_custkey || '.pdf' AS target, 'raw/' || (o_orderkey % 3) || '/notes' AS folder,
         'raw/' || CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE o_orderkey % 3 END || '/_resources/p' || o_custkey || '.pdf' AS new_path FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def moved_link_targets(spark, sf):
    """Two moved files share each name; the one nearer to the linking note is meant."""
    moves = table(spark, sf, "customer").select(
        F.explode(F.array(F.lit("0"), F.lit("1"))).alias("d"), s(F.col("c_custkey")).alias("k")
    ).select(_cat("raw/", F.col("d"), "/converted/p", F.col("k"), ".pdf").alias("old"),
             _cat("raw/", F.col("d"), "/_resources/p", F.col("k"), ".pdf").alias("new"))
    targets = table(spark, sf, "orders").select(
        _cat("p", s(F.col("o_custkey")), ".pdf").alias("target"), _cat("raw/", s(F.col("o_orderkey") % 3), "/notes").alias("folder")
    )
    return relocation.moved_targets(targets, moves)


@query(
    "moved_link_branches",
    """WITH m AS (SELECT c_custkey AS k, 'raw/f' || (c_custkey % 7) || '/d' || (c_custkey % 3) || '/' || CASE WHEN c_custkey % 3 = 0 THEN 'same.pdf'
                  ELSE 'n' || c_custkey || CASE WHEN c_custkey % 3 = 1 THEN '.pdf' ELSE '.md' END END AS old FROM customer),
      moved_v AS (SELECT DISTINCT old, 'raw/new/' || old AS new FROM m),
      asked_v AS (
        SELECT DISTINCT 'raw/f' || (o_orderkey % 9) || '/d' || (o_orderkey % 4) AS folder, CASE o_orderkey % 6
          WHEN 0 THEN 'same.pdf' WHEN 1 THEN old WHEN 2 THEN replace(old, 'raw/', '') WHEN 3 THEN '../../f' || (k % 7) || '/d' || (k % 3) || '/n' || k || '.pdf'
          WHEN 4 THEN './n' || k ELSE 'd' || (k % 3) || '/n' || k || '.md' END AS target, o_orderkey % 6 AS way, k, old
        FROM orders JOIN m ON k = o_custkey),
      found_v AS (
        SELECT target, folder, new, CASE WHEN way IN (1, 2) AND a.old = v.old THEN 1000 WHEN way = 3 AND a.old = v.old AND k % 3 = 1 THEN 1000
            WHEN v.old LIKE folder || '/%' THEN 3 WHEN split_part(v.old, '/', 2) = split_part(folder, '/', 2) THEN 2 ELSE 1 END AS score, v.old
        FROM asked_v a JOIN moved_v v ON (way = 0 AND v.old LIKE '%/same.pdf') OR (way IN (1, 2) AND v.old = a.old)
          OR (way = 3 AND k % 3 = 1 AND v.old = a.old) OR (way = 4 AND k % 3 = 2 AND v.old = a.old) OR (way = 5 AND k % 3 = 2 AND v.old = a.old))
      SELECT target, folder, arg_min(new, (-score, length(old), old)) AS new_path FROM found_v GROUP BY ALL""",
)
def moved_link_branches(spark, sf):
    """A third of the moved files share one name; targets are exact, below raw/, relative, by tail and without extension."""
    key, k = F.col("o_orderkey"), F.col("o_custkey")
    kept = table(spark, sf, "customer").select("c_custkey")

    def old(c):
        name = F.when(c % 3 == 0, "same.pdf").when(c % 3 == 1, _cat("n", s(c), ".pdf")).otherwise(_cat("n", s(c), ".md"))
        return _cat("raw/f", s(c % 7), "/d", s(c % 3), "/", name)

    moves = kept.select(old(F.col("c_custkey")).alias("old")).distinct().select("old", _cat("raw/new/", F.col("old")).alias("new"))
    way = key % 6
    target = (
        F.when(way == 0, "same.pdf").when(way == 1, old(k)).when(way == 2, F.regexp_replace(old(k), "raw/", ""))
        .when(way == 3, _cat("../../f", s(k % 7), "/d", s(k % 3), "/n", s(k), ".pdf")).when(way == 4, _cat("./n", s(k)))
        .otherwise(_cat("d", s(k % 3), "/n", s(k), ".md"))
    )
    asked = table(spark, sf, "orders").join(shuffled(kept), k == F.col("c_custkey"), "left_semi")
    targets = asked.select(target.alias("target"), _cat("raw/f", s(key % 9), "/d", s(key % 4)).alias("folder"))
    return relocation.moved_targets(targets, moves)


@query(
    "files_after_moves",
    """SELECT 'raw/' || CASE WHEN c_custkey % 3 = 0 THEN 'b/' ELSE 'a/' END || c_custkey || '.md' AS path FROM customer""",
)
def files_after_moves(spark, sf):
    paths_ = table(spark, sf, "customer").select("c_custkey", _cat("raw/a/", s(F.col("c_custkey")), ".md").alias("path"))
    moves = paths_.where("c_custkey % 3 = 0").select(F.col("path").alias("old"), _cat("raw/b/", s(F.col("c_custkey")), ".md").alias("new"))
    return relocation.files_after(paths_.select("path"), moves)


@query(
    "offset_edits",
    """SELECT doc_id AS key, md5(CASE WHEN n < 40 THEN 'AB' || text
           ELSE 'AB' || text[1:2] || 'C' || text[6:10] || text[14:14] || 'long insert' || text[15:20] || '😀' || text[28:n] || 'end' END) AS content_md5,
         CASE WHEN n < 40 THEN 1 ELSE 6 END AS applied
       FROM (SELECT doc_id, text, length(text) AS n FROM documents)""",
)
def offset_edits(spark, sf):
    """Whole documents with insertions, deletions and replacements; some overlap, some lie outside."""
    docs = table(spark, sf, "documents").select(F.col("doc_id"), s(F.col("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    n = F.length("content")

    def edit(start, stop, text_):
        return F.struct(F.lit(start).cast("bigint").alias("start") if isinstance(start, int) else start.cast("bigint").alias("start"),
                        F.lit(stop).cast("bigint").alias("stop") if isinstance(stop, int) else stop.cast("bigint").alias("stop"), F.lit(text_).alias("text"))

    long = F.array(
        edit(0, 0, "AB"), edit(2, 5, "C"), edit(4, 9, "overlaps"), edit(10, 13, ""), edit(12, 12, "inside"), edit(14, 14, "long insert"),
        edit(20, 27, "😀"), edit(26, 30, "overlaps too"), edit(n, n, "end"), edit(n, n + 1, "outside"), edit(33, 31, "backwards"),
    )
    short = F.array(edit(0, 0, "AB"), edit(n + 5, n + 6, "outside"))
    edits_ = docs.select("path", F.explode(F.when(n < 40, short).otherwise(long)).alias("e")).select("path", "e.*")
    rows = edits.applied(docs, edits_)
    return rows.select(F.col("path").cast("bigint").alias("key"), F.md5(F.col("content").cast("binary")).alias("content_md5"), F.col("applied").cast("int").alias("applied"))


@query(
    "migration_links",
    """SELECT o_orderkey AS key, c_custkey IS NOT NULL AS changed,
         '---' || chr(10) || 'source: "' || CASE WHEN c_custkey IS NULL THEN 'converted/n ' || o_custkey || '.pdf' ELSE '_resources/n ' || o_custkey || '.pdf' END || '"' || chr(10)
         || '---' || chr(10) || '[[n ' || o_custkey || '.pdf]] ![[' || CASE WHEN c_custkey IS NULL THEN 'converted/n ' ELSE 'raw/c/_resources/n ' END || o_custkey || '.pdf|x]] [t]('
         || CASE WHEN c_custkey IS NULL THEN 'converted/n%20' ELSE 'raw/c/_resources/n%20' END || o_custkey || '.pdf#p) [[' ||
         CASE WHEN c_custkey IS NULL THEN 'converted/N ' || o_custkey ELSE 'raw/c/N ' || o_custkey END || '|y]] ![i](' ||
         CASE WHEN c_custkey IS NULL THEN 'raw/c/converted/n ' ELSE 'raw/c/_resources/n ' END || o_custkey || '.pdf) [[Order ' || o_orderkey || ']]' AS content
       FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) ON c_custkey = o_custkey""",
)
def migration_links(spark, sf):
    """Order notes that cite files of an older layout by every kind of link; two thirds of those files move."""
    key, k = F.col("o_orderkey"), s(F.col("o_custkey"))
    owners = table(spark, sf, "customer").select(F.col("c_custkey"), s(F.col("c_custkey")).alias("k"))
    moves = owners.where("c_custkey % 3 > 0").select(F.explode(F.array(
        F.struct(_cat("raw/c/converted/n ", F.col("k"), ".pdf").alias("old"), _cat("raw/c/_resources/n ", F.col("k"), ".pdf").alias("new")),
        F.struct(_cat("raw/c/converted/N ", F.col("k"), ".md").alias("old"), _cat("raw/c/N ", F.col("k"), ".md").alias("new")),
    )).alias("m")).select("m.*")
    notes = table(spark, sf, "orders").select(
        key, _cat("raw/c/Order ", s(key), ".md").alias("path"),
        _cat('---\nsource: "converted/n ', k, '.pdf"\n---\n[[n ', k, ".pdf]] ![[converted/n ", k, ".pdf|x]] [t](converted/n%20", k, ".pdf#p) [[converted/N ", k,
             "|y]] ![i](raw/c/converted/n ", k, ".pdf) [[Order ", s(key), "]]").alias("content"),
    )
    files = notes.select("path").unionByName(owners.select(_cat("raw/c/converted/n ", F.col("k"), ".pdf").alias("path"))).unionByName(
        owners.select(_cat("raw/c/converted/N ", F.col("k"), ".md").alias("path"))
    )
    done = edits.applied(notes, edits.migration_edits(notes.select("path", "content"), files, moves)).select("path", F.col("content").alias("_new"))
    rows = notes.join(shuffled(done), "path", "left")
    return rows.select(F.col("o_orderkey").alias("key"), F.col("_new").isNotNull().alias("changed"), F.coalesce("_new", "content").alias("content"))


@query(
    "log_after_moves",
    """SELECT event_id AS line_no, 'raw/' || CASE WHEN user_id % 3 = 0 THEN 'new' ELSE 'users' END || '/u' || user_id || '.md' AS file, user_id % 3 = 0 AS moved
       FROM events WHERE event_id % 97 <> 5 AND event_id % 101 <> 7""",
)
def log_after_moves(spark, sf):
    log = documents_vault.event_log(spark, sf)
    users = table(spark, sf, "events").where("user_id % 3 = 0").select(s(F.col("user_id")).alias("u")).distinct()
    moves = users.select(_cat("raw/users/u", F.col("u"), ".md").alias("old"), _cat("raw/new/u", F.col("u"), ".md").alias("new"))
    lines = edits.log_after_moves(log, moves).where(F.try_parse_json("value").isNotNull())
    return lines.select("line_no", F.get_json_object("value", "$.file").alias("file"), "moved")


# streams ---------------------------------------------------------------------------------------
def _work_folder(spark) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(
    "stream_ingest",
    with_views(DOCS)
    + """SELECT path AS file, hash, mtime FROM files_v f
         WHERE NOT EXISTS (SELECT 1 FROM log_v l WHERE l.file = f.path AND l.mtime = f.mtime)
           AND hash NOT IN (SELECT hash FROM log_v WHERE hash IS NOT NULL)
           AND path NOT IN (SELECT file FROM log_v GROUP BY file HAVING bool_and(hash IS NULL))
           AND NOT (lang <> 'en' AND doc_id % 3 = 0 AND source = 'src7' AND strftime(day, '%Y-%m-%d') IN
             (SELECT strftime(d.day, '%Y-%m-%d') FROM files_v d JOIN labels USING (doc_id)
              WHERE d.source = 'src7' AND quality = 1 AND d.doc_id % 3 = 0))""",
)
def stream_ingest(spark, sf):
    """Documents as a file stream, deduplicated against the log batch by batch."""
    schema = table(spark, sf, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/documents*.parquet").select(
        documents_vault.doc_path().alias("path"), (F.lit(1_577_836_800) + F.col("doc_id") * 3600).alias("mtime"),
        F.col("text").alias("content"),
    )
    work = _work_folder(spark)
    run = stream_ingest_module.start(
        stream, f"{work}/log", f"{work}/checkpoint", earlier_log=documents_vault.document_log(spark, sf)
    )
    run.awaitTermination()
    return spark.read.parquet(f"{work}/log").select("file", "hash", "mtime")


@query(
    "stream_latest_log",
    """SELECT 'u' || user_id AS file, max(strftime(ts, '%Y-%m-%d %H')) AS date,
         max_by(event_id, strftime(ts, '%Y-%m-%d %H') || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS line_no,
         count(*) AS entries FROM events GROUP BY ALL""",
)
def stream_latest_log(spark, sf):
    schema = table(spark, sf, "events").schema
    entries = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").select(
        _cat("u", s(F.col("user_id"))).alias("file"), F.date_format("ts", "yyyy-MM-dd HH").alias("date"),
        F.col("event_id").alias("line_no"),
    )
    work = _work_folder(spark)
    stream_ledger.start(entries, f"{work}/log", f"{work}/checkpoint").awaitTermination()
    return stream_ledger.state(spark.read.parquet(f"{work}/log/batch_*"))


@query(
    "session_activity",
    """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
       g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_event,
         count(*) AS events FROM g GROUP BY user_id, s""",
)
def session_activity(spark, sf):
    rows = stream_sessions.sessions(table(spark, sf, "events"), "user_id", "ts", "6 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("user_id", stamp("start"), stamp("last_event"), "events")


#: Six deliveries of documents as files: all, renamed, touched, modified, unchanged, and renamed with a change.
_DELIVERIES = [
    ("doc_id % 5 <> 1", "doc_id", 0, ""), ("doc_id % 4 = 0", "doc_id || ' renamed'", 0, ""), ("doc_id % 3 = 0", "doc_id", 10, ""),
    ("doc_id % 7 = 0", "doc_id", 20, " revised"), ("true", "doc_id", 0, ""), ("doc_id % 6 = 0", "doc_id || ' renamed'", 30, " twice"),
]


def _delivered_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {n} AS n, 'raw/' || {name} || '.md' AS file, 'sha256:' || sha256(text || '{more}') AS hash, doc_id * 100 + {late} AS mtime"
        f" FROM documents WHERE {wanted}" for n, (wanted, name, late, more) in enumerate(_DELIVERIES)
    )
    return f"""WITH d AS ({rows}),
      t AS (SELECT *, min(n) OVER (PARTITION BY file, mtime) AS first_time FROM d),
      h AS (SELECT *, min(n) OVER (PARTITION BY hash) AS first_hash FROM t WHERE n = first_time)
      SELECT file, hash, mtime FROM h WHERE n = first_hash"""


#: Documents for each file of a delivery; the smallest delivery has a seventh of them, so that no file of several stays empty.
_DOCS_OF_FILE = 10_000


def _files_of_delivery(docs: int) -> int:
    return docs // _DOCS_OF_FILE + 1


@query("stream_ingest_deliveries", _delivered_sql())
def stream_ingest_deliveries(spark, sf):
    """Documents delivered as files six times, a micro-batch each, with a restart after the third."""
    docs, work = table(spark, sf, "documents"), _work_folder(spark)
    schema = "path string, mtime bigint, content string"
    files = _files_of_delivery(docs.count())  # as many in each delivery, so that each is one micro-batch
    for n, (wanted, name, late, more) in enumerate(_DELIVERIES):
        docs.where(wanted).select(
            F.expr(f"'raw/' || {name} || '.md'").alias("path"), (F.col("doc_id") * 100 + late).cast("bigint").alias("mtime"),
            _cat(F.col("text"), more).alias("content"),
        ).repartition(files, "path").write.parquet(f"{work}/in/{n}")
        if n in (2, len(_DELIVERIES) - 1):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{work}/in/*")
            stream_ingest_module.start(stream, f"{work}/log", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/log").select("file", "hash", "mtime")
