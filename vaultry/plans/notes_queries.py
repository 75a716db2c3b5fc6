"""Notes read and written as texts: relations, indexes, companions, exports, renames, edits of front matter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, frontmatter, names, paths
from ..operators import conversion, date_assignment, drift, inventory, ledger, mail, privacy, rewrite, stamping, topics, transcripts
from ..sources.tables import table
from . import documents_vault as vault
from . import projection
from .change_queries import linked_text
from .ingest_queries import DOCS, _moved
from .registry import query
from .text_vault import _cat, s
from .vault_sql import KINDS, with_views


def raw_texts(spark, sf):
    """Orders as raw notes with front matter, headings and links to parts."""
    key = F.col("o_orderkey")
    head = F.when(key % 3 == 0, _cat("title: 'Note ", s(key), "'\n")).otherwise("")
    day = F.when(key % 2 == 0, _cat("date: ", F.date_format("o_orderdate", "yyyy-MM-dd"), "\n")).otherwise(
        _cat("created: ", F.date_format("o_orderdate", "yyyy-MM"), "\n")
    )
    return table(spark, sf, "orders").select(
        _cat("raw/notes/n", s(key), ".md").alias("path"),
        _cat("---\n", head, day, "type: mail\n---\n# About ", F.col("o_orderpriority"), " #\n\n## Part\nSee [[Part  ", s(F.col("o_custkey")), "|x]], [[wiki/a/Part ",
             s(F.col("o_custkey")), ".md#h]] and [[", F.col("o_orderstatus"), "]]\n### ", s(key), "\n").alias("content"),
    )


_NOTE = """
text_v AS (
  SELECT *, 'raw/notes/n' || o_orderkey || '.md' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'Note ' || o_orderkey ELSE rtrim('About ' || o_orderpriority, '# ') END AS title,
    strftime(o_orderdate, '%Y-%m') || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '-%d') ELSE '' END AS day FROM orders)"""


@query(
    "raw_note_index",
    with_views(_NOTE) + "SELECT path, title, day AS date, 'mail' AS source_type, 'About ' || o_orderpriority || '|Part|' || o_orderkey AS headings FROM text_v",
)
def raw_note_index(spark, sf):
    rows = inventory.index_raw_notes(raw_texts(spark, sf))
    return rows.select("path", "title", "date", "source_type", F.array_join("headings", "|").alias("headings"))


@query(
    "drift_relations_from_texts",
    with_views(_NOTE)
    + """SELECT DISTINCT title_key, path AS note, day AS date FROM (
           SELECT path, day, unnest(['part ' || o_custkey, lower(o_orderstatus), lower(title)]) AS title_key FROM text_v)""",
)
def drift_relations_from_texts(spark, sf):
    texts = raw_texts(spark, sf)
    return drift.note_relations(texts, inventory.index_raw_notes(texts)).select("title_key", "note", "date")


@query(
    "front_matter_entries",
    with_views(_NOTE)
    + """SELECT path, e.k AS key, e.v AS value FROM (SELECT path, unnest(list_filter([{'k': 'title', 'v': CASE WHEN o_orderkey % 3 = 0 THEN title END},
           {'k': CASE WHEN o_orderkey % 2 = 0 THEN 'date' ELSE 'created' END, 'v': day}, {'k': 'type', 'v': 'mail'}], lambda x: x.v IS NOT NULL)) AS e FROM text_v)""",
)
def front_matter_entries(spark, sf):
    return raw_texts(spark, sf).select("path", F.explode(frontmatter.inventory_map(F.col("content"))).alias("key", "value"))


@query(
    "front_matter_flags",
    with_views(_NOTE)
    + r"""SELECT path, replace(content, '---' || chr(10) || '#', 'stub: true' || chr(10) || '---' || chr(10) || '#') AS added, replace(content, 'type: mail' || chr(10), '') AS removed
          FROM (SELECT path, '---' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN 'title: ''Note ' || o_orderkey || '''' || chr(10) ELSE '' END
            || CASE WHEN o_orderkey % 2 = 0 THEN 'date: ' ELSE 'created: ' END || day || chr(10) || 'type: mail' || chr(10) || '---' || chr(10) || '# About ' || o_orderpriority
            || ' #' || chr(10) || chr(10) || '## Part' || chr(10) || 'See [[Part  ' || o_custkey || '|x]], [[wiki/a/Part ' || o_custkey || '.md#h]] and [[' || o_orderstatus || ']]'
            || chr(10) || '### ' || o_orderkey || chr(10) AS content FROM text_v)""",
)
def front_matter_flags(spark, sf):
    c = F.col("content")
    return raw_texts(spark, sf).select(
        "path", rewrite.with_key(c, "stub", "true").alias("added"), rewrite.without_key(c, "type", "mail").alias("removed")
    )


@query(
    "rewrite_md_links",
    """SELECT o_orderkey AS key, '[t](New (1).md)' AS link, 't Part (' || o_custkey || ')' AS plain FROM orders""",
)
def rewrite_md_links(spark, sf):
    rows = linked_text(spark, sf).select("key", "target", _cat("[t](", F.col("target"), "#x)").alias("c"), _cat("[t](", F.col("target"), ") [](", F.col("target"), ")").alias("d"))
    return rows.select(
        "key", rewrite.replaced_mdlink(F.col("c"), F.col("target"), F.lit("New (1).md")).alias("link"), rewrite.delinked_mdlink(F.col("d"), F.col("target")).alias("plain")
    )


@query(
    "log_relink_applied",
    with_views(DOCS)
    + """, gone_v AS (SELECT doc_id AS line_no, path AS file, hash FROM files_v WHERE lang IN ('fr', 'de')),
    free_v AS (SELECT hash, count(*) AS n, min('raw/renamed/' || doc_id || '.md') AS new_file, min_by(mtime, 'raw/renamed/' || doc_id || '.md') AS t FROM files_v WHERE lang = 'fr' GROUP BY hash),
    first_v AS (SELECT hash, min(line_no) AS first_line FROM gone_v GROUP BY hash)
    SELECT doc_id AS line_no, CASE WHEN take THEN new_file ELSE path END AS file, CASE WHEN take THEN t ELSE 1 END AS mtime FROM (
      SELECT f.*, new_file, t, coalesce(lang IN ('fr', 'de') AND n = 1 AND doc_id = first_line, false) AS take
      FROM files_v f LEFT JOIN free_v USING (hash) LEFT JOIN first_v USING (hash))""",
)
def log_relink_applied(spark, sf):
    log, on_disk = _moved(spark, sf)
    log = log.withColumn("mtime", F.lit(1).cast("bigint"))
    return ledger.apply_relinks(log, ledger.relink(log, on_disk)).select("line_no", "file", "mtime")


@query(
    "date_arguments",
    """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def date_arguments(spark, sf):
    key = F.col("o_orderkey")
    day = lambda f: F.date_format("o_orderdate", f)
    given = F.when(key % 5 == 0, day("yyyy-MM-dd")).when(key % 5 == 1, day("d-M-yyyy")).when(key % 5 == 2, day("yyyy/MM/dd")).when(
        key % 5 == 3, day("yyyy-M-d")
    ).otherwise(F.when(key % 2 == 0, day("yyyy.MM.dd")).otherwise("2024-02-31"))
    return table(spark, sf, "orders").select(key.alias("key"), F.date_format(dates.from_argument(given), "yyyy-MM-dd").alias("day"))


@query(
    "mail_notes",
    """SELECT page_id, day, md5('---' || chr(10) || 'type: email' || chr(10) || 'subject: "About \\"' || url || '\\""' || chr(10) || 'date: ' || day || chr(10)
         || 'source: "_resources/' || name || '"' || chr(10) || 'from: "a@x.org"' || chr(10) || 'to: "b@x.org"' || chr(10) || CASE WHEN page_id % 3 = 0 THEN 'cc: "c@x.org"' || chr(10) ELSE '' END
         || '---' || chr(10) || chr(10) || '![[' || name || ']]' || chr(10) || chr(10) || '```' || chr(10) || 'Date: ' || day || chr(10) || 'From: a@x.org' || chr(10) || 'To: b@x.org' || chr(10)
         || CASE WHEN page_id % 3 = 0 THEN 'CC: c@x.org' || chr(10) ELSE '' END || 'Subject: About "' || url || '"' || chr(10) || '```' || chr(10) || chr(10)
         || '> [!ocr-extractor]- Extracted text' || chr(10) || '> line one' || chr(10) || '>' || chr(10) || '> ' || url || chr(10)) AS note_md5
       FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN strftime(DATE '2020-01-01' + CAST(page_id % 900 AS INTEGER), '%Y-%m-%d') ELSE strftime(to_timestamp(page_id * 86400), '%Y-%m-%d') END AS day,
               CASE WHEN page_id % 2 = 0 THEN strftime(DATE '2020-01-01' + CAST(page_id % 900 AS INTEGER), '%Y-%m-%d') || 'T10_11_12+02_00 mail.html' ELSE 'mail ' || page_id || '.html' END AS name FROM pages)""",
)
def mail_notes(spark, sf):
    """Mail exports with a stamp in their name or none, as companion notes."""
    key = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd")
    name = F.when(key % 2 == 0, _cat(day, "T10_11_12+02_00 mail.html")).otherwise(_cat("mail ", s(key), ".html"))
    rows = table(spark, sf, "pages").select("page_id", "url", name.alias("name")).withColumns({
        "date": mail.export_date(_cat("raw/", F.col("name")), key * 86400), "from": F.lit("a@x.org"), "to": F.lit("b@x.org"),
        "cc": F.when(key % 3 == 0, "c@x.org").otherwise(""), "bcc": F.lit(""), "subject": _cat('About "', F.col("url"), '"'), "body": _cat("line one\n\n", F.col("url")),
    })
    return rows.select("page_id", F.col("date").alias("day"), F.md5(mail.mail_note(F.col("name")).cast("binary")).alias("note_md5"))


@query(
    "generic_notes",
    r"""SELECT doc_id, md5('---' || chr(10) || 'source: "_resources/f' || doc_id || '.txt"' || chr(10) || 'converted: 2024-05-06' || chr(10) || '---' || chr(10) || chr(10)
          || '![[f' || doc_id || '.txt]]' || chr(10) || chr(10) || '> [!ocr-extractor]- Extracted text' || chr(10)
          || array_to_string(list_transform(string_split(t, chr(10)), lambda l: regexp_replace('> ' || l, '\s+$', '')), chr(10)) || chr(10)) AS note_md5
        FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x0A\x20-\x7E]', '?', 'g'), '\s+$', '') AS t FROM documents)""",
)
def generic_notes(spark, sf):
    """Whole documents as companions of text files."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x0A\x20-\x7E]", "?"), r"\s+\z", "").alias("t")
    )
    note = mail.generic_note(_cat("f", s(F.col("doc_id")), ".txt"), F.col("t"), "2024-05-06")
    return docs.select("doc_id", F.md5(note.cast("binary")).alias("note_md5"))


@query(
    "companion_notes_built",
    r"""SELECT doc_id, md5('---' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'a: b' || chr(10) || 'source: "_resources/f.eml"' || chr(10) || 'c: d' WHEN 1 THEN 'a: b' || chr(10) || 'source: "_resources/f.eml"'
            ELSE 'source: "_resources/f.eml"' || chr(10) || 'converted: 2024-05-06' END || chr(10) || '---' || chr(10) || chr(10) || '![[f.eml]]' || chr(10)
          || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# Title' || CASE WHEN doc_id % 5 < 3 THEN chr(10) || chr(10) || '```' || chr(10) || 'From: a' || chr(10) || 'To: b' || chr(10) || '```' ELSE '' END || chr(10)
               WHEN doc_id % 5 < 3 THEN chr(10) || '```' || chr(10) || 'From: a' || chr(10) || 'To: b' || chr(10) || '```' || chr(10) ELSE '' END
          || chr(10) || '> [!ocr-extractor]- Extracted text' || chr(10)
          || array_to_string(list_transform(string_split(CASE WHEN doc_id % 5 = 3 THEN '```' || chr(10) || 'code: x' || chr(10) || '```' || chr(10) ELSE '' END || 'begin ' || t || ' end', chr(10)), lambda l: regexp_replace('> ' || l, '\s+$', '')), chr(10)) || chr(10)) AS note_md5
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x0A\x20-\x7E]', '?', 'g') AS t FROM documents)""",
)
def companion_notes_built(spark, sf):
    """Whole documents as converted notes: with and without front matter, a title, the header of a mail, other code."""
    key = F.col("doc_id")
    front = F.when(key % 3 == 0, "---\na: b\nsource: old.eml\nc: d\n---\n").when(key % 3 == 1, "---\na: b\n---\n").otherwise("")
    title = F.when(key % 2 == 0, "\n# Title\n\n").otherwise("")
    code = F.when(key % 5 < 2, "```\nFrom: a\nTo: b\n```\n\n---\n\n").when(key % 5 == 2, "```\nFrom: a\nTo: b\n```\n").when(key % 5 == 3, "```\ncode: x\n```\n").otherwise("")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x0A\x20-\x7E]", "?")
    legacy = F.concat(front, title, code, F.lit("begin "), plain, F.lit(" end\n\n"))
    note = conversion.companion(legacy, F.lit("f.eml"), F.lit("_resources/f.eml"), "2024-05-06")
    return table(spark, sf, "documents").select("doc_id", F.md5(note.cast("binary")).alias("note_md5"))


@query(
    "transcript_markdown",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '_' || (t // 3600) || ':' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') || '_' || chr(10) ELSE '' END
         || CASE WHEN turn % 3 > 0 THEN '**' || role || '**' || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'more' AS markdown
       FROM (SELECT *, turn * 997 AS t FROM conversations)""",
)
def transcript_markdown(spark, sf):
    turn = F.col("turn")
    rows = table(spark, sf, "conversations").withColumns({
        "timed": turn % 2 == 0, "start": turn * 997.0, "speaker": F.when(turn % 3 > 0, F.col("role")).otherwise(""), "paragraphs": F.array("text", F.lit("more")),
    })
    return rows.select("conv_id", "turn", transcripts.block_markdown(F.lit(True)).alias("markdown"))


@query(
    "curly_quote_repair",
    """SELECT 'wiki/people/It’s ' || c_custkey || '.md' AS old, 'wiki/people/It''s ' || c_custkey || '.md' AS new, 'a’b [[It''s ' || c_custkey || '|’]] ![[x''.png]] [‘q’](p''.md) [w](https://x/’)' AS content
       FROM customer WHERE c_custkey % 3 > 0""",
)
def curly_quote_repair(spark, sf):
    """Pages with curly quotes in their names, a third of them taken, and the links that name them."""
    key = s(F.col("c_custkey"))
    pages = table(spark, sf, "customer").select(
        "c_custkey", _cat("wiki/people/It’s ", key, ".md").alias("path"), _cat("a’b [[It’s ", key, "|’]] ![[x’.png]] [‘q’](p’.md) [w](https://x/’)").alias("content")
    )
    taken = pages.where("c_custkey % 3 = 0").select(_cat("wiki/people/It's ", key, ".md").alias("path"))
    renames = rewrite.curly_renames(pages.select("path").unionByName(taken))
    return renames.join(pages.select(F.col("path").alias("old"), rewrite.straightened_links(F.col("content")).alias("content")), "old").select("old", "new", "content")


@query(
    "path_readings",
    with_views(DOCS)
    + """SELECT path, true AS source, m > 0 AS candidate, doc_id % 5 > 0 AS content_page,
           CASE WHEN length(path) <= 24 THEN path ELSE path[1:10] || '...' || path[-11:] END AS short, '"' || doc_id || '" - x...->' AS safe
         FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'raw/' || source || '/_index.md'
           WHEN doc_id % 4 = 0 THEN 'raw/' || source || '/d' || doc_id || '.MD' ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 4 END AS m FROM files_v)""",
)
def path_readings(spark, sf):
    key = F.col("doc_id")
    path = F.when(key % 5 == 0, _cat("raw/", F.col("source"), "/_index.md")).when(key % 4 == 0, _cat("raw/", F.col("source"), "/d", s(key), ".MD")).otherwise(vault.doc_path())
    rows = table(spark, sf, "documents").select(key, path.alias("path"))
    p = F.col("path")
    return rows.select(
        p, privacy.is_source(p).alias("source"), privacy.is_ingest_candidate(p).alias("candidate"), date_assignment.is_content_page(p).alias("content_page"),
        paths.truncated(p, 24, 10).alias("short"), names.file_name_safe(_cat("“", s(key), "”\u00a0–\u202fx…→")).alias("safe"),
    )


@query(
    "stamp_outcomes",
    """SELECT action, count(*) AS pages FROM (SELECT CASE WHEN doc_id % 7 = 6 THEN 'missing' WHEN doc_id % 5 > 0 THEN 'stamped' ELSE 'skipped' END AS action FROM documents) GROUP BY ALL""",
)
def stamp_outcomes(spark, sf):
    """Requests of which some name pages that are not there."""
    key = F.col("doc_id")
    page = _cat("wiki/people/d", s(key), ".md")
    docs = table(spark, sf, "documents")
    pages = docs.where("doc_id % 7 < 6").select(
        page.alias("path"), _cat("# T\n", F.regexp_replace("text", r"\^", ""), F.when(key % 5 == 0, "\n> [!provenance]\n> schema: kb-prov-v1\n").otherwise("")).alias("content")
    )
    requests = stamping.specs(docs.select(
        page.alias("page"), F.lit("historical").alias("stamp_mode"), F.lit(None).cast("string").alias("mode"), F.lit("why").alias("reason"),
        F.array(F.lit("raw/a.md")).alias("sources"), F.lit(None).cast("array<string>").alias("related_raw"), F.lit("2024-01-01").alias("latest_related_raw_date"),
    ))
    return stamping.outcome_counts(stamping.stamp(requests, pages, "2024-06-01"))


@query(
    "topic_index_pages",
    f"""WITH d AS (SELECT doc_id, {KINDS}[doc_id % 8 + 1] AS topic FROM documents)
        SELECT topic, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY path)) AS entries_md5 FROM (
          SELECT topic, 'wiki/' || topic || '/doc ' || doc_id || '.md' AS path, '- [[wiki/' || topic || '/doc ' || doc_id || '|T ' || doc_id || ']] — No summary available.' AS line
          FROM d WHERE topic NOT IN ('people', 'systems'))
        GROUP BY topic UNION ALL SELECT topic, 1, md5('_No pages yet._') FROM (SELECT unnest(['people', 'systems']) AS topic)""",
)
def topic_index_pages(spark, sf):
    """Lines of every topic's index; two topics have no pages."""
    key = F.col("doc_id")
    kind = projection.choose(projection.KINDS, key % 8)
    pages = table(spark, sf, "documents").select(_cat("wiki/", kind, "/doc ", s(key), ".md").alias("path"), _cat("# T ", s(key), "\n## More\n").alias("content"))
    kept = pages.where(~F.col("path").rlike(r"\Awiki/(?:people|systems)/"))
    lines = topics.index_pages(topics.index_entries(kept), "2024-05-06").where("ordinal = 10")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line"))), lambda e: e["line"]), "\n")
    return lines.groupBy("topic").agg(F.count(F.lit(1)).alias("lines"), F.md5(whole.cast("binary")).alias("entries_md5"))
