"""Markdown round trips: parse documents built from columns, expect what the columns say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import fix_cycle, inventory, mentions, page_checks, provenance, vault_links
from ..session import checkpointed
from ..sources.tables import table
from . import documents_vault, text_vault
from .registry import query
from .vault_sql import KINDS, PAGES, STATUSES, with_views

PARTS = f"""
parts_v AS (
  SELECT *, p_partkey AS pk, CAST(p_size % 5 AS INTEGER) AS n,
         'wiki/' || {KINDS}[p_partkey % 8 + 1] || '/Part ' || p_partkey || '.md' AS path FROM part),
numbers_v AS (SELECT *, unnest(range(1, n + 1)) AS i FROM parts_v),
given_v AS (
  SELECT *, {STATUSES}[(pk + i) % 7 + 1] AS status, CASE WHEN i = 2 THEN 'certain' ELSE 'high' END AS confidence,
         '2024-05-1' || i AS observed,
         CASE i WHEN 4 THEN '2024-05-02' WHEN 1 THEN 'soon' ELSE '2024-06-01' END AS checked,
         ['', 'raw/a, with comma.md|raw/b.md', 'raw/q, x.md|raw/z.md', 'one|two'][(pk + i) % 4 + 1] AS sources
  FROM numbers_v)"""

_TITLE = """CASE WHEN pk % 3 = 0 THEN p_name || ' sheet'
  WHEN pk % 4 <> 0 THEN CASE WHEN contains(p_brand, '#') THEN rtrim(p_brand, '#') ELSE p_brand END
  ELSE 'Part ' || pk END"""


@query(
    "parse_pages_roundtrip",
    with_views(PARTS)
    + f"""SELECT path, split_part(path, '/', 2) AS kind, {_TITLE} AS title,
            CASE WHEN pk % 6 = 0 THEN NULL WHEN pk % 5 = 0 THEN '{vocab.MINIMAL_MIGRATION}'
                 WHEN pk % 5 = 1 THEN '{vocab.INFERRED_MIGRATION}' END AS migration_status,
            CASE WHEN pk % 6 = 0 THEN NULL WHEN pk % 7 = 0 THEN 'other' ELSE 'kb-prov-v1' END
              AS provenance_schema
          FROM parts_v""",
)
def parse_pages_roundtrip(spark, sf):
    return inventory.index_pages(text_vault.wiki_pages(spark, sf))


_HEADS = """CASE i WHEN 1 THEN 'Facts' WHEN 2 THEN 'Facts' ELSE
  CASE WHEN pk % 4 = 0 THEN 'Facts>Deep part' ELSE 'Facts>Deep part' END END"""


@query(
    "parse_blocks_roundtrip",
    with_views(PARTS)
    + f""", ids_v AS (
            SELECT *, 'b' || i AS id FROM given_v UNION ALL SELECT *, 'twin' FROM given_v WHERE i = 4
            UNION ALL SELECT * REPLACE (9 AS i), 'inside' FROM given_v WHERE i = 1 AND pk % 2 = 0
            UNION ALL SELECT *, 9, NULL, NULL, NULL, NULL, NULL, 'inside' FROM parts_v
              WHERE n = 0 AND pk % 2 = 0)
          SELECT path, id,
            CASE WHEN id = 'inside' THEN '```' || chr(10) || 'sample'
                 ELSE 'The ' || p_type || ' costs ' || i || chr(10) || 'per unit.' END AS text,
            concat_ws('>', CASE WHEN pk % 4 <> 0 THEN rtrim(p_brand, '#') END,
              CASE WHEN id = 'inside' THEN CASE WHEN n >= 3 THEN 'Facts>Deep part' WHEN n > 0 THEN 'Facts' END
                   WHEN i <= 2 THEN 'Facts' ELSE 'Facts>Deep part' END) AS heading_path,
            CASE WHEN pk % 6 > 0 AND id LIKE 'b%' THEN status ELSE 'unknown' END AS status,
            CASE WHEN pk % 6 > 0 AND id LIKE 'b%' THEN confidence ELSE 'unknown' END AS confidence,
            CASE WHEN pk % 6 > 0 AND id LIKE 'b%' THEN sources ELSE '' END AS sources,
            CASE WHEN pk % 6 > 0 AND id LIKE 'b%' THEN observed END AS observed,
            CASE WHEN pk % 6 > 0 AND id LIKE 'b%' THEN checked END AS checked,
            pk % 6 > 0 AND id LIKE 'b%' AS has_provenance
          FROM ids_v""",
)
def parse_blocks_roundtrip(spark, sf):
    return inventory.index_blocks(text_vault.wiki_pages(spark, sf)).select(
        "path", "id", "text", F.array_join("heading_path", ">").alias("heading_path"), "status", "confidence",
        F.array_join("sources", "|").alias("sources"), "observed", "checked", "has_provenance",
    )


_CLAIMS = "('current', 'historical', 'stale', 'disputed', 'superseded')"


@query(
    "parse_issues_roundtrip",
    with_views(PARTS)
    + f"""SELECT path, 'b' || i AS block_id, code, severity FROM (
            SELECT *, unnest(list_filter([
              CASE WHEN pk % 5 <> 0 AND status IN {_CLAIMS} AND sources = '' THEN 'missing-sources' END,
              CASE WHEN confidence = 'certain' THEN 'invalid-confidence' END,
              CASE WHEN status = 'superseded' THEN 'missing-superseded-by' END,
              CASE WHEN i = 1 THEN 'invalid-date' END,
              CASE WHEN i = 4 THEN 'date-order' END], lambda c: c IS NOT NULL)) AS code
            FROM given_v WHERE pk % 6 > 0) CROSS JOIN LATERAL (
            SELECT CASE WHEN code = 'missing-sources' THEN 'warning' ELSE 'error' END AS severity)
          UNION ALL SELECT path, 'ghost', 'missing-block-id', 'error' FROM parts_v WHERE pk % 6 > 0 AND pk % 9 = 0
          UNION ALL SELECT path, NULL, 'invalid-schema', 'error' FROM parts_v WHERE pk % 6 > 0 AND pk % 7 = 0""",
)
def parse_issues_roundtrip(spark, sf):
    return provenance.validate(text_vault.wiki_pages(spark, sf)).select("path", "block_id", "code", "severity")


_KIND = f"{KINDS}[o_custkey % 8 + 1]"
LINKS = f"""
orders_v AS (SELECT *, 'raw/orders/Order ' || o_orderkey || '.md' AS path, {_KIND} AS kind FROM orders),
links_v AS (
  SELECT path, o_orderkey AS ok, o_custkey AS ck, kind, unnest([
    {{'line': 2, 'type': 'wikilink', 'target': 'Part ' || o_custkey}},
    {{'line': 4, 'type': 'wikilink', 'target': 'Part ' || o_custkey}},
    {{'line': 4, 'type': 'wikilink', 'target': 'wiki/' || kind || '/Part ' || o_custkey}},
    {{'line': 5, 'type': 'image', 'target': kind || '/Part ' || o_custkey || '.md'}},
    {{'line': 5, 'type': 'markdown', 'target': '../../wiki/' || kind || '/Part%20' || o_custkey || '.md'}},
    {{'line': 6, 'type': 'wikilink', 'target': 'Part-' || o_custkey}},
    {{'line': 7, 'type': 'wikilink', 'target': 'Part ' || o_orderkey}},
    {{'line': 8, 'type': 'markdown', 'target': 'https://example.com/' || o_orderkey}},
    {{'line': 9, 'type': 'image', 'target': 'wiki/' || kind || '/Part%20' || o_orderkey || '.md'}},
    {{'line': 9, 'type': 'wikilink', 'target': 'Part ' || o_custkey || ' .md'}}], recursive := true)
  FROM orders_v),
known_v AS (SELECT p_partkey AS pk, 'wiki/' || {KINDS}[p_partkey % 8 + 1] || '/Part ' || p_partkey || '.md' AS page FROM part),
broken_v AS (
  SELECT path, line, type, target, ck FROM links_v WHERE
    CASE WHEN type = 'wikilink' AND starts_with(target, 'Part-') THEN true
         WHEN type = 'wikilink' AND target = 'Part ' || ok AND line = 7 THEN ok NOT IN (SELECT pk FROM known_v)
         WHEN type = 'wikilink' AND target LIKE '% .md' THEN true
         WHEN starts_with(target, 'https:') THEN false
         WHEN type = 'image' AND line = 9
           THEN replace(target, '%20', ' ') NOT IN (SELECT page FROM known_v)
         ELSE ck NOT IN (SELECT pk FROM known_v) END)"""


@query("links_extract_roundtrip", with_views(LINKS) + "SELECT path, line, type, target FROM links_v")
def links_extract_roundtrip(spark, sf):
    found = vault_links.extract(text_vault.order_notes(spark, sf), images=True)
    return found.select("path", F.col("line").cast("bigint").alias("line"), "type", "target")


def _broken(spark, sf, keys=None):
    # resolution reads the links twice; parsing the notes once is cheaper
    found = checkpointed(vault_links.extract(text_vault.order_notes(spark, sf), images=True))
    return found, vault_links.broken(found, text_vault.vault_files(spark, sf), keys)


@query("broken_links", with_views(LINKS) + "SELECT path, line, type, target FROM broken_v")
def broken_links(spark, sf):
    return _broken(spark, sf)[1].select("path", F.col("line").cast("bigint").alias("line"), "type", "target")


@query(
    "broken_links_by_type",
    with_views(LINKS)
    + """SELECT type, count(*) AS links, (SELECT count(*) FROM broken_v b WHERE b.type = l.type) AS broken
         FROM links_v l GROUP BY type""",
)
def broken_links_by_type(spark, sf):
    return vault_links.counts_by_type(*_broken(spark, sf))


@query(
    "link_fix_suggestions",
    with_views(LINKS)
    + """SELECT DISTINCT target, 'Part ' || ck AS suggested_fix, 'fuzzy' AS rule
         FROM broken_v JOIN known_v ON pk = ck
         WHERE starts_with(target, 'Part-') OR target LIKE '% .md'""",
)
def link_fix_suggestions(spark, sf):
    files = text_vault.vault_files(spark, sf)
    keys = checkpointed(vault_links.file_keys(files))
    bad = _broken(spark, sf, keys)[1].where("wiki_style")
    return vault_links.suggestions(bad, files, keys)


@query(
    "link_context",
    with_views(LINKS)
    + """SELECT path, line, c AS context_line FROM (
           SELECT path, line, unnest(range(greatest(line - 2, 1), least(line + 2, 10) + 1)) AS c
           FROM (SELECT DISTINCT path, line FROM broken_v))""",
)
def link_context(spark, sf):
    rows = vault_links.source_context(_broken(spark, sf)[1], text_vault.order_notes(spark, sf))
    return rows.select(
        "path", F.col("line").cast("bigint").alias("line"), F.col("context_line").cast("bigint").alias("context_line")
    )


@query(
    "orphans",
    with_views(LINKS)
    + """SELECT page AS path FROM known_v WHERE pk NOT IN (SELECT o_custkey FROM orders)
           AND pk NOT IN (SELECT o_orderkey FROM orders)""",
)
def orphans(spark, sf):
    pages = text_vault.wiki_pages(spark, sf)
    notes = pages.unionByName(text_vault.order_notes(spark, sf))
    return page_checks.orphans(notes, text_vault.vault_files(spark, sf))


@query(
    "backlink_counts",
    with_views(LINKS)
    + """SELECT page, count(DISTINCT path) AS sources FROM known_v JOIN
           (SELECT path, ck AS pk FROM links_v UNION SELECT path, ok FROM links_v) USING (pk) GROUP BY page""",
)
def backlink_counts(spark, sf):
    files = text_vault.vault_files(spark, sf)
    pages = page_checks.topic_pages(files)
    edges = page_checks.note_wikilinks(text_vault.order_notes(spark, sf))
    return page_checks.backlinks(edges, files, pages)


@query(
    "stubs",
    """SELECT 'wiki/concepts/doc ' || doc_id || '.md' AS path, words FROM (
         SELECT doc_id, lang, CAST(coalesce(list_sum(list_transform(list_filter(
             list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda l: trim(l)),
             lambda l: l <> '' AND NOT starts_with(l, '#')),
             lambda l: len(regexp_split_to_array(l, '\\s+')))), 0) AS BIGINT) AS words
         FROM documents) WHERE words < 60 AND lang <> 'es'""",
)
def stubs(spark, sf):
    """Documents as pages under a raised threshold; Spanish ones acknowledge being stubs."""
    head = F.when(F.col("lang") == "es", "---\nstub: true\n---\n").otherwise("---\ntype: x\n---\n# Title\n- [[link]]\n")
    pages = table(spark, sf, "documents").select(
        F.concat(F.lit("wiki/concepts/doc "), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(head, "text").alias("content"),
    )
    return page_checks.stubs(pages, threshold=60).withColumn("words", F.col("words").cast("bigint"))


@query(
    "loose_files",
    """SELECT path FROM (
         SELECT CASE WHEN page_id % 3 = 0 THEN 'raw/clips/_resources/' WHEN page_id % 3 = 1 THEN 'raw/clips/'
                     ELSE 'docs/' END || 'page' || page_id
                || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '.md' END AS path FROM pages)
       WHERE starts_with(path, 'raw/') AND NOT contains(path, '_resources') AND path LIKE '%.html'""",
)
def loose_files(spark, sf):
    key = F.col("page_id")
    folder = F.when(key % 3 == 0, "raw/clips/_resources/").when(key % 3 == 1, "raw/clips/").otherwise("docs/")
    files = table(spark, sf, "pages").select(
        F.concat(folder, F.lit("page"), key.cast("string"), F.when(key % 2 == 0, ".html").otherwise(".md")).alias("path")
    )
    return page_checks.loose_files(files)


@query(
    "text_mentions",
    r"""SELECT DISTINCT stem, 'doc ' || doc_id AS path FROM (
          SELECT DISTINCT regexp_extract(text, '^\s*([^\s.,;:!?]+ [^\s.,;:!?]+)', 1) AS stem FROM benchmark)
        JOIN documents ON contains(text, stem)
        WHERE stem <> '' AND regexp_matches(text, '(^|[^\p{L}\p{N}_\p{M}])' || regexp_escape(stem) || '($|[^\p{L}\p{N}_\p{M}])')""",
)
def text_mentions(spark, sf):
    """First two words of every benchmark item looked up in all documents."""
    stems = table(spark, sf, "benchmark").select(
        F.regexp_extract("text", r"(?U)\A\s*([^\s.,;:!?]+ [^\s.,;:!?]+)", 1).alias("stem")
    ).where("stem <> ''")
    texts = table(spark, sf, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")
    )
    return page_checks.text_mentions(stems, texts)


_TITLED = r"""
titled_v AS (
  SELECT doc_id, lang, text, 'wiki/t' || doc_id || '/' || coalesce(w, 'none') || '.md' AS path, doc_id % 2 = 0 AND length(w) >= 3 AS asked, w
  FROM (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}_]+')[3] AS w FROM documents)),
word_v AS (SELECT w, min(path) AS first, count(*) AS n FROM titled_v WHERE asked GROUP BY w)"""


def _titled(spark, sf):
    """Documents as pages named by their third word, so that thousands of titles are common words; every second one is looked for."""
    # up to the third word and no further into the text
    word = text.find(F.col("text"), r"\A(?:[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++){2}[^\p{L}\p{N}_]++([\p{L}\p{N}_]++)")
    path = F.concat(F.lit("wiki/t"), F.col("doc_id").cast("string"), F.lit("/"), F.coalesce(word, F.lit("none")), F.lit(".md"))
    pages = table(spark, sf, "documents").select("doc_id", "lang", path.alias("path"), F.col("text").alias("content"), word.alias("word"))
    return pages.drop("word"), pages.where("doc_id % 2 = 0 AND length(word) >= 3").select("path")


@query(
    "title_links_many",
    with_views(_TITLED)
    + r"""SELECT t.doc_id AS key, md5(array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'),
            lambda x: CASE WHEN list_contains(l.words, x) AND NOT (x = w AND asked AND alone) THEN '[[' || x || ']]' ELSE x END), '')) AS content_md5
          FROM (SELECT titled_v.*, coalesce(word_v.n = 1, false) AS alone FROM titled_v LEFT JOIN word_v USING (w)) t
          CROSS JOIN (SELECT list(w) AS words FROM word_v) l""",
)
def title_links_many(spark, sf):
    pages, asked = _titled(spark, sf)
    keys = pages.select("path", F.col("doc_id").alias("key"))
    return mentions.linked(pages, asked).join(keys, "path").select("key", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(
    "orphan_repairs",
    with_views(_TITLED)
    + r""", flag_v AS (SELECT *, doc_id % 3 = 0 AS flagged FROM titled_v),
      piece_v AS (SELECT path, lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS x FROM titled_v),
      hit_v AS (SELECT path, lang, x, count(*) AS n FROM piece_v WHERE x IN (SELECT w FROM word_v) GROUP BY ALL),
      page_v AS (SELECT path, w, flagged, row_number() OVER (PARTITION BY w ORDER BY path) AS turn FROM flag_v WHERE asked AND lang = 'en'),
      link_v AS (
        SELECT o.path, h.n FROM hit_v h JOIN page_v o ON o.w = h.x AND h.lang = 'en'
          LEFT JOIN page_v f ON f.w = h.x AND f.turn = 1
        WHERE (o.turn = 1 AND h.path <> o.path) OR (o.turn = 2 AND h.path = f.path)),
      sum_v AS (SELECT path, sum(n)::BIGINT AS references_linked, count(*) AS files_changed FROM link_v GROUP BY path)
      SELECT path, coalesce(references_linked, 0) AS references_linked, coalesce(files_changed, 0) AS files_changed,
        CASE WHEN references_linked > 0 AND flagged THEN 'removed_orphan_false'
          WHEN references_linked IS NULL AND NOT flagged AND w IN (SELECT x FROM hit_v WHERE lang <> 'en') THEN 'added_orphan_false' END AS frontmatter
      FROM page_v LEFT JOIN sum_v USING (path)""",
)
def orphan_repairs(spark, sf):
    """English pages among themselves, the other languages as raw texts."""
    pages, asked = _titled(spark, sf)
    head = F.when(F.col("doc_id") % 3 == 0, "---\norphan: false\n---\n").otherwise("---\ntype: page\n---\n")
    wiki = pages.where("lang = 'en'").select("path", F.concat(head, F.col("content")).alias("content"))
    raw = pages.where("lang <> 'en'").select("path", "content")
    return mentions.repairs(wiki, raw, asked.join(wiki.select("path"), "path", "left_semi"))


# a target before an escaped alias bar gets a suggestion, but no edit reaches it: it remains
_CYCLE = """
first_v AS (
  SELECT path, type, target, target LIKE '% .md' AND ck IN (SELECT pk FROM known_v) AS fixable FROM broken_v
  UNION ALL SELECT path, 'wikilink', 'Ghost', true FROM orders_v WHERE o_orderkey % 3 < 2
  UNION ALL SELECT path, 'wikilink', 'Ghost', o_orderkey % 3 = 0 FROM orders_v WHERE o_orderkey % 3 <> 1),
cycle_v AS (SELECT type, count(*) AS found, count(*) FILTER (fixable) AS fixed, count(*) FILTER (NOT fixable) AS remaining FROM first_v GROUP BY type)"""


def _with_ghosts(spark, sf):
    """Order notes that also link to pages nobody has: in front matter, in the text, or in both."""
    key = F.col("path")
    number = F.regexp_extract(key, r"([0-9]+)\.md", 1).cast("bigint")
    ghost = F.concat(F.lit("[[Ghost "), number.cast("string"), F.lit("]]"))
    notes = text_vault.order_notes(spark, sf)
    head = F.when(number % 3 < 2, F.concat(F.lit("---\nsee: "), ghost, F.lit("\n"))).otherwise("---\n")
    tail = F.when(number % 3 != 1, F.concat(F.lit("and "), ghost, F.lit(" too\n"))).otherwise("")
    return notes.select("path", F.concat(head, F.substring("content", 5, 1 << 20), tail).alias("content"))


@query("fix_cycle_summary", with_views(LINKS, _CYCLE) + "SELECT * FROM cycle_v")
def fix_cycle_summary(spark, sf):
    return fix_cycle.repair(_with_ghosts(spark, sf), text_vault.vault_files(spark, sf)).summary


@query(
    "fix_cycle_report",
    with_views(LINKS, _CYCLE)
    + """SELECT '  broken links : ' || sum(found) || ' found, ' || sum(fixed) || ' fixed, ' || sum(remaining) || ' remaining' AS line FROM cycle_v
         UNION ALL SELECT '     ' || rpad(type, 10, ' ') || ': ' || found || ' found, ' || fixed || ' fixed, ' || remaining || ' remaining' FROM cycle_v""",
)
def fix_cycle_report(spark, sf):
    summary = fix_cycle.repair(_with_ghosts(spark, sf), text_vault.vault_files(spark, sf)).summary
    return fix_cycle.summary_lines(summary).orderBy("at").select("line")


@query(
    "link_context_text",
    with_views(LINKS)
    + r"""SELECT b.path, b.line, c.c AS context_line, ['---', 'related: [[Part ' || o_custkey || ']]', '---', 'See [[Part ' || o_custkey || ']] and [[wiki/' || kind || '/Part ' || o_custkey || '|alias]].',
            '![[' || kind || '/Part ' || o_custkey || '.md]] [text](../../wiki/' || kind || '/Part%20' || o_custkey || '.md#anchor)', '- [[Part-' || o_custkey || '\|table]]', 'x [[Part ' || o_orderkey || ']] y',
            '[web](https://example.com/' || o_orderkey || ')', '![alt](wiki/' || kind || '/Part%20' || o_orderkey || '.md) [[Part ' || o_custkey || ' .md]]',
            '[[Part ' || o_orderkey || '|(broken link) gone]]'][c.c] AS text
          FROM (SELECT DISTINCT path, line FROM broken_v) b JOIN orders_v USING (path), LATERAL (SELECT unnest(range(greatest(b.line - 2, 1), least(b.line + 2, 10) + 1)) AS c) c""",
)
def link_context_text(spark, sf):
    rows = vault_links.source_context(_broken(spark, sf)[1], text_vault.order_notes(spark, sf))
    return rows.select("path", F.col("line").cast("bigint").alias("line"), F.col("context_line").cast("bigint").alias("context_line"), "text")
