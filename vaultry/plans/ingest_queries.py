"""Log maintenance, privacy, deduplicated ingestion and batching."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import skew
from ..operators import ingest, ledger, privacy
from ..operators.ledger import content_hash
from ..session import checkpoint_folder
from ..sinks import log_files
from ..sources.ledger import updated_line
from ..sources.tables import table
from . import documents_vault as vault
from .registry import query
from .vault_sql import with_views

EVENTS = r"""
lines_v AS (
  SELECT event_id AS line_no, 'raw/users/u' || user_id || '.md' AS file,
         strftime(ts, '%Y-%m-%d %H') AS date, event_type,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         event_id % 97 = 5 AS malformed, event_type IN ('purchase', 'signup') AS lists
  FROM events WHERE event_id % 97 = 5 OR event_id % 101 <> 7),
alive_v AS (
  SELECT * FROM lines_v WHERE NOT malformed AND file IN
    (SELECT 'raw/users/u' || c_custkey || '.md' FROM customer WHERE c_mktsegment <> 'BUILDING')),
best_v AS (
  SELECT file, count(*) AS entries, max(line_no) FILTER (rn = 1) AS line_no,
         max(date) FILTER (rn = 1) AS date,
         bool_or(event_type IN ('view', 'purchase', 'signup')) FILTER (rn = 1) AS given
  FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY date DESC, line_no DESC) AS rn
        FROM alive_v) GROUP BY file),
items_v AS (
  SELECT file, item, min(line_no * 10 + pos) AS seen FROM (
    SELECT file, line_no, 0 AS pos, 'wiki/p' || k || '.md' AS item FROM alive_v WHERE lists
    UNION ALL SELECT file, line_no, 1, 'wiki/p' || (k % 7) || '.md' FROM alive_v WHERE lists)
  GROUP BY ALL),
merged_v AS (
  SELECT file, string_agg(item, '|' ORDER BY seen) AS created FROM items_v GROUP BY file)"""


@query(
    "log_prune",
    with_views(EVENTS)
    + """SELECT b.file, b.line_no, b.date, b.entries,
           CASE WHEN m.created IS NOT NULL THEN m.created WHEN b.given THEN '' END AS pages_created
         FROM best_v b LEFT JOIN merged_v m USING (file)""",
)
def log_prune(spark, sf):
    pruned = ledger.prune(vault.event_log(spark, sf), vault.user_files(spark, sf))
    return pruned.select(
        "file", "line_no", "date", "entries", F.array_join("pages_created", "|").alias("pages_created")
    )


@query(
    "log_prune_counts",
    with_views(EVENTS)
    + """SELECT (SELECT count(*) FROM best_v) AS kept,
           (SELECT count(*) FROM lines_v WHERE NOT malformed) - (SELECT count(*) FROM alive_v) AS dropped,
           (SELECT count(*) FROM lines_v WHERE malformed) AS malformed,
           (SELECT count(*) FROM alive_v) - (SELECT count(*) FROM best_v) AS duplicates""",
)
def log_prune_counts(spark, sf):
    return ledger.prune_counts(vault.event_log(spark, sf), vault.user_files(spark, sf))


@query(
    "log_rewrite_lines",
    r"""SELECT event_id AS line_no, json_extract_string(props, '$.k') AS hash, event_type,
          'raw/users/u' || user_id || '.md' AS file
        FROM events WHERE event_id % 97 <> 5 AND event_id % 101 <> 7""",
)
def log_rewrite_lines(spark, sf):
    """Stamp a value into every valid log line, then read it back with the unknown keys."""
    lines = vault.event_log_lines(spark, sf).join(
        table(spark, sf, "events").select(
            F.col("event_id").alias("line_no"), F.get_json_object("props", "$.k").alias("k")
        ),
        "line_no",
    )
    valid = lines.where(F.try_parse_json("value").isNotNull()).select(
        "line_no", updated_line(F.col("value"), {"hash": F.col("k")}).alias("line")
    )
    return valid.select(
        "line_no", F.get_json_object("line", "$.hash").alias("hash"),
        F.get_json_object("line", "$.note.type").alias("event_type"),
        F.get_json_object("line", "$.file").alias("file"),
    )


DOCS = """
docs_v AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN strftime(day, '%Y-%m-%d') || ' '
                 WHEN doc_id % 3 = 1 THEN strftime(day, '%Y-%m') || '_' ELSE '' END
            || 'doc ' || doc_id || ext AS name, 'sha256:' || sha256(text) AS hash,
         1577836800 + doc_id * 3600 AS mtime
  FROM (SELECT *, DATE '2020-01-01' + CAST(doc_id % 300 AS INTEGER) AS day,
               CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt' WHEN 'de' THEN '.eml'
                    ELSE '.html' END AS ext FROM documents)),
files_v AS (SELECT *, 'raw/' || source || '/' || name AS path FROM docs_v),
log_v AS (
  SELECT doc_id AS line_no,
         CASE WHEN source = 'src7' AND quality = 1
              THEN 'raw/src7/converted/' || name || '.md' ELSE path END AS file,
         CASE WHEN toxic = 1 THEN 'sha256:' || sha256(text || '!') WHEN quality = 1 THEN hash END AS hash,
         CASE WHEN toxic = 1 THEN mtime - 5 WHEN quality = 1 THEN mtime END AS mtime
  FROM files_v JOIN labels USING (doc_id))"""

_PROTECTED = """
refusing_v AS (SELECT * FROM files_v WHERE lang = 'en' AND n_chars < 800),
protected_v AS (
  SELECT path, NULL AS linked_from FROM refusing_v
  UNION
  SELECT f.path, r.path FROM refusing_v r JOIN files_v f ON f.doc_id = r.doc_id + 1
  WHERE f.path <> r.path)"""


def _closure_sql() -> str:
    return with_views(DOCS, _PROTECTED) + "SELECT path, linked_from FROM protected_v"


@query("privacy_protected", _closure_sql())
def privacy_protected(spark, sf):
    notes = privacy.protected_notes(vault.notes(spark, sf))
    return privacy.closure_relative(notes, vault.files(spark, sf).select("path"))


@query("privacy_protected_by_name", _closure_sql())
def privacy_protected_by_name(spark, sf):
    notes = privacy.protected_notes(vault.notes(spark, sf))
    return privacy.closure_by_name(notes, vault.files(spark, sf).select("path"))


@query(
    "privacy_linked_counts",
    with_views(DOCS, _PROTECTED)
    + """SELECT r.path AS file, count(p.path) AS linked_count FROM refusing_v r
         LEFT JOIN protected_v p ON p.linked_from = r.path GROUP BY ALL""",
)
def privacy_linked_counts(spark, sf):
    notes = privacy.protected_notes(vault.notes(spark, sf))
    return privacy.linked_counts(privacy.closure_by_name(notes, vault.files(spark, sf).select("path")))


_COMPANION = "(source = 'src5' AND lang <> 'en')"
_NEW = f"""
new_v AS (
  SELECT * FROM files_v f
  WHERE path NOT IN (SELECT path FROM protected_v)
    AND NOT EXISTS (SELECT 1 FROM log_v l WHERE l.file = f.path AND l.mtime = f.mtime)
    AND f.hash NOT IN (SELECT hash FROM log_v WHERE hash IS NOT NULL)
    AND f.path NOT IN (SELECT file FROM log_v GROUP BY file HAVING bool_and(hash IS NULL))
    AND NOT {_COMPANION}
    AND NOT (lang <> 'en' AND doc_id % 3 = 0 AND (source, strftime(day, '%Y-%m-%d')) IN
      (SELECT ('src7', strftime(d.day, '%Y-%m-%d')) FROM files_v d JOIN labels USING (doc_id)
       WHERE d.source = 'src7' AND quality = 1 AND d.doc_id % 3 = 0)))"""


def _new(spark, sf):
    files = vault.files(spark, sf)
    notes = privacy.protected_notes(vault.notes(spark, sf))
    protected = privacy.protected_by_name(notes, files.select("path"))
    companions = ingest.companions(files.select("path"), vault.companion_notes(spark, sf))
    new = ingest.new_files(
        files.select("path", "mtime", "content"), vault.document_log(spark, sf), protected, companions
    )
    return files, protected, new


@query("ingest_companions", with_views(DOCS) + f"SELECT path FROM files_v WHERE {_COMPANION}")
def ingest_companions(spark, sf):
    return ingest.companions(vault.files(spark, sf).select("path"), vault.companion_notes(spark, sf))


@query("ingest_dedup", with_views(DOCS, _PROTECTED, _NEW) + "SELECT path, mtime, hash FROM new_v")
def ingest_dedup(spark, sf):
    return _new(spark, sf)[2]


_ORDER_KEY = """CASE doc_id % 3 WHEN 0 THEN strftime(day, '%Y-%m-%d') || 'T23:59:59'
  WHEN 1 THEN strftime(day, '%Y-%m') || '-31T23:59:59'
  ELSE strftime(to_timestamp(mtime), '%Y-%m-%dT%H:%M:%S') END"""


@query(
    "ingest_batches",
    with_views(DOCS, _PROTECTED, _NEW)
    + f"""SELECT path, order_key, position, (position - 1) // 10 + 1 AS batch FROM (
          SELECT path, {_ORDER_KEY} AS order_key,
                 row_number() OVER (ORDER BY {_ORDER_KEY} DESC, path) AS position FROM new_v)""",
)
def ingest_batches(spark, sf):
    return ingest.batches(_new(spark, sf)[2]).select("path", "order_key", "position", "batch")


@query(
    "ingest_summary",
    with_views(DOCS, _PROTECTED, _NEW)
    + """SELECT scanned, new, protected, scanned - new - protected AS already_imported,
           CAST(ceil(new / 10) AS BIGINT) AS batches FROM (SELECT
           (SELECT count(*) FROM files_v) AS scanned, (SELECT count(*) FROM new_v) AS new,
           (SELECT count(DISTINCT path) FROM protected_v) AS protected)""",
)
def ingest_summary(spark, sf):
    files, protected, new = _new(spark, sf)
    return ingest.summary(files.select("path"), new, protected)


def _moved(spark, sf):
    """Logged documents whose files stayed, were renamed or vanished, by language."""
    docs = vault.files(spark, sf).withColumn("hash", content_hash(F.col("content")))
    log = docs.select(F.col("doc_id").alias("line_no"), F.col("path").alias("file"), "hash")
    renamed = F.concat(F.lit("raw/renamed/"), F.col("doc_id").cast("string"), F.lit(".md"))
    on_disk = docs.where("lang <> 'de'").select(
        F.when(F.col("lang") == "fr", renamed).otherwise(F.col("path")).alias("path"), "hash", "mtime"
    )
    return log, on_disk


@query(
    "log_relink",
    with_views(DOCS)
    + """, gone_v AS (SELECT doc_id AS line_no, path AS file, hash FROM files_v WHERE lang IN ('fr', 'de')),
    free_v AS (SELECT hash, count(*) AS n, min('raw/renamed/' || doc_id || '.md') AS new_file
               FROM files_v WHERE lang = 'fr' GROUP BY hash),
    first_v AS (SELECT hash, min(line_no) AS first_line FROM gone_v GROUP BY hash)
    SELECT line_no, file, outcome, CASE WHEN outcome = 'relinked' THEN new_file END AS new_file FROM (
      SELECT g.*, new_file, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous'
        WHEN line_no = first_line THEN 'relinked' ELSE 'claimed' END AS outcome
      FROM gone_v g LEFT JOIN free_v USING (hash) LEFT JOIN first_v USING (hash))""",
)
def log_relink(spark, sf):
    log, on_disk = _moved(spark, sf)
    return ledger.relink(log, on_disk).select("line_no", "file", "outcome", "new_file")


@query(
    "log_stamp",
    with_views(DOCS)
    + """SELECT l.line_no, l.file, coalesce(l.hash, f.hash) AS hash, coalesce(l.mtime, f.mtime) AS mtime,
           (l.hash IS NULL OR l.mtime IS NULL) AND f.path IS NOT NULL AS stamped
         FROM log_v l LEFT JOIN files_v f ON f.path = l.file""",
)
def log_stamp(spark, sf):
    log = vault.document_log(spark, sf).withColumn("malformed", F.lit(False))
    files = vault.files(spark, sf).select("path", content_hash(F.col("content")).alias("hash"), "mtime")
    return ledger.stamp(log, files).select("line_no", "file", "hash", "mtime", "stamped")


@query(
    "log_baseline",
    with_views(DOCS, _PROTECTED)
    + """SELECT path AS file, hash, mtime, 'migration-baseline' AS session FROM files_v
         WHERE path NOT IN (SELECT path FROM protected_v)
           AND path NOT IN (SELECT file FROM log_v)
           AND hash NOT IN (SELECT hash FROM log_v WHERE hash IS NOT NULL)""",
)
def log_baseline(spark, sf):
    files = vault.files(spark, sf)
    notes = privacy.protected_notes(vault.notes(spark, sf))
    protected = privacy.protected_paths(privacy.closure_relative(notes, files.select("path")))
    candidates = files.select("path", content_hash(F.col("content")).alias("hash"), "mtime")
    rows = ledger.baseline(candidates, vault.document_log(spark, sf), protected, "2024-01-01 00:00:00")
    return rows.select("file", "hash", "mtime", "session")


_COMMITTED = """
kept_v AS (
  SELECT b.file, b.date, CASE WHEN m.created IS NOT NULL THEN m.created WHEN b.given THEN '' END AS pages_created, false AS baseline, b.line_no AS place
  FROM best_v b LEFT JOIN merged_v m USING (file)),
more_v AS (
  SELECT 'raw/users/u' || c_custkey || '.md' AS file, '2024-01-01 00:00:00' AS date, '' AS pages_created, true AS baseline,
         10000000000 + c_custkey AS place
  FROM customer WHERE c_mktsegment <> 'BUILDING' AND 'raw/users/u' || c_custkey || '.md' NOT IN (SELECT file FROM best_v))"""


@query(
    "log_commit",
    with_views(EVENTS, _COMMITTED)
    + "SELECT file, date, pages_created, baseline, row_number() OVER (ORDER BY place) AS position FROM (SELECT * FROM kept_v UNION ALL SELECT * FROM more_v)",
)
def log_commit(spark, sf):
    """The log as files: appended, rewritten after pruning, a baseline appended, each commit sent twice; read back in its order."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    existing, order = vault.user_files(spark, sf), [F.col("line_no")]
    entries = ledger.baseline(
        existing.select("path", F.sha2("path", 256).alias("hash"), F.lit(7).cast("bigint").alias("mtime")),
        ledger.prune(vault.event_log(spark, sf), existing), spark.createDataFrame([], "path string"), "2024-01-01 00:00:00",
    )
    number = F.regexp_extract("file", r"u([0-9]+)\.md", 1).cast("bigint")
    for _ in range(2):
        log_files.append(spark, folder, vault.event_log_lines(spark, sf), order, "first")
        log_files.rewrite(spark, folder, lambda log: ledger.pruned_lines(log, existing), order, "prune")
        log_files.append(spark, folder, ledger.baseline_lines(entries), [number], "baseline")
    rows = skew.numbered(log_files.read(spark, folder), order, "position")
    return rows.select(
        "file", "date", F.array_join("pages_created", "|").alias("pages_created"), F.coalesce("migration_baseline", F.lit(False)).alias("baseline"), "position"
    )
