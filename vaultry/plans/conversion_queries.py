"""Converted notes matched with their originals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversion
from ..sources.tables import table
from .registry import query
from .text_vault import _cat, s

# one folder holds the documents of one source; every three documents share a name, and so do their files
_NOTES = """
WITH RECURSIVE d AS (SELECT doc_id, doc_id // 3 AS k, 'raw/' || coalesce(source, 'none') AS parent FROM documents),
note_v AS (
  SELECT *, parent || '/converted/' || stem || '.md' AS note FROM (
    SELECT *, CASE doc_id % 3 WHEN 0 THEN 'paper ' || k WHEN 1 THEN 'Paper_' || k || '.pdf' ELSE 'copy ' || doc_id END AS stem,
      CASE WHEN doc_id % 3 = 2 AND k % 4 < 2 THEN parent || '/paper ' || k || '.pdf' WHEN doc_id % 3 = 2 AND k % 4 = 2 THEN 'paper ' || k || '.docx' END AS src
    FROM d)),
file_v AS (
  SELECT DISTINCT parent, k, f[1]::INT AS place, f[2] AS stem, parent || f[3] || '/' || f[2] || f[4] AS original, f[2] || f[4] AS name FROM (
    SELECT parent, k, unnest([CASE WHEN k % 2 = 0 THEN ['0', 'paper ' || k, '', '.pdf'] END, CASE WHEN k % 3 = 0 THEN ['1', 'paper ' || k, '/converted', '.docx'] END,
      CASE WHEN k % 5 = 0 THEN ['2', 'paper-' || k, '/_resources', '.pdf'] END, CASE WHEN k % 7 = 0 THEN ['0', 'Paper ' || k, '', '.txt'] END]) AS f FROM d)
  WHERE f IS NOT NULL),
pair_v AS (
  SELECT note, parent, original, min(rank) AS rank FROM (
    SELECT n.note, n.parent, f.original, CASE WHEN n.src = f.original THEN '0' ELSE '1' END AS rank
      FROM note_v n JOIN file_v f ON n.parent = f.parent AND (n.src = f.original OR (n.src = f.name AND f.place < 2))
    UNION ALL SELECT n.note, n.parent, f.original, (6 + f.place) || f.name FROM note_v n JOIN file_v f ON n.parent = f.parent AND n.stem IN (f.stem, f.name))
  GROUP BY ALL),
list_v AS (
  SELECT parent, note, row_number() OVER (PARTITION BY parent ORDER BY note) AS n, coalesce(c, []) AS c FROM note_v LEFT JOIN (
    SELECT note, list(original ORDER BY rank, original) AS c FROM pair_v GROUP BY note) USING (note)),
walk_v AS (
  SELECT parent, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS original FROM (SELECT DISTINCT parent FROM d)
  UNION ALL
  SELECT parent, n, CASE WHEN original IS NULL THEN claimed ELSE list_append(claimed, original) END, note, original FROM (
    SELECT l.parent, l.n, w.claimed, l.note, list_filter(l.c, lambda x: NOT list_contains(w.claimed, x))[1] AS original
    FROM walk_v w JOIN list_v l ON l.parent = w.parent AND l.n = w.n + 1)),
exact_v AS (SELECT note, original FROM walk_v WHERE original IS NOT NULL),
open_v AS (
  SELECT l.parent, l.note, row_number() OVER (PARTITION BY l.parent ORDER BY note) AS n, coalesce(x.c, []) AS c FROM list_v l LEFT JOIN (
    SELECT n.note, list(DISTINCT f.original) AS c FROM note_v n JOIN file_v f ON n.parent = f.parent AND n.k = f.k AND n.doc_id % 3 < 2
    WHERE f.original NOT IN (SELECT original FROM exact_v) GROUP BY n.note) x USING (note)
  WHERE l.note NOT IN (SELECT note FROM exact_v)),
fuzzy_v AS (
  SELECT parent, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS original FROM (SELECT DISTINCT parent FROM d)
  UNION ALL
  SELECT parent, n, CASE WHEN len(free) = 1 THEN list_append(claimed, free[1]) ELSE claimed END, note, CASE WHEN len(free) = 1 THEN free[1] END FROM (
    SELECT o.parent, o.n, w.claimed, o.note, list_filter(o.c, lambda x: NOT list_contains(w.claimed, x)) AS free
    FROM fuzzy_v w JOIN open_v o ON o.parent = w.parent AND o.n = w.n + 1))
SELECT note, coalesce(e.original, f.original) AS original, CASE WHEN e.original IS NOT NULL THEN 'exact' WHEN f.original IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS way
FROM note_v LEFT JOIN exact_v e USING (note) LEFT JOIN (SELECT note, original FROM fuzzy_v WHERE original IS NOT NULL) f USING (note)
"""


@query("converted_note_match", _NOTES)
def converted_note_match(spark, sf):
    """Documents as notes of an older layout; originals lie beside, above and in resources, some named by several notes."""
    key, k = F.col("doc_id"), F.floor(F.col("doc_id") / 3)
    docs = table(spark, sf, "documents").withColumn("parent", _cat("raw/", F.coalesce("source", F.lit("none"))))
    kind, folder = key % 3, F.col("parent")
    stem = F.when(kind == 0, _cat("paper ", s(k))).when(kind == 1, _cat("Paper_", s(k), ".pdf")).otherwise(_cat("copy ", s(key)))
    told = F.when(k % 4 < 2, _cat(folder, "/paper ", s(k), ".pdf")).when(k % 4 == 2, _cat("paper ", s(k), ".docx"))
    head = F.coalesce(F.when(kind == 2, _cat('---\nsource: "', told, '"\n---\n')), F.lit("---\ntype: note\n---\n"))
    notes = docs.select(_cat(folder, "/converted/", stem, ".md").alias("path"), F.concat(head, F.col("text")).alias("content"))
    there = F.array(
        F.when(k % 2 == 0, _cat("/paper ", s(k), ".pdf")), F.when(k % 3 == 0, _cat("/converted/paper ", s(k), ".docx")),
        F.when(k % 5 == 0, _cat("/_resources/paper-", s(k), ".pdf")), F.when(k % 7 == 0, _cat("/Paper ", s(k), ".txt")),
    )
    originals = docs.select(folder.alias("f"), F.explode(F.array_compact(there)).alias("p")).select(F.concat("f", "p").alias("path")).distinct()
    return conversion.match(notes, originals.unionByName(notes.select("path")))
