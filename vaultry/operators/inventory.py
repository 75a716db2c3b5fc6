"""Pages, canonical blocks and raw notes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, paths, text, vocab
from . import provenance

# Fixed value: a heading line.
_HEADING = r"(?U)\A(#{1,6})[\s\x1c-\x1f]+(.+?)[\s\x1c-\x1f]*\z"


def heading_text(c: Column) -> Column:
    return text.strip(F.regexp_replace(text.strip(c), r"#+\z", ""))


def headings(body_lines: Column) -> Column:
    return F.transform(
        F.filter(body_lines, lambda l: l.rlike(_HEADING)),
        lambda l: heading_text(F.regexp_extract(l, _HEADING, 2)),
    )


def title(path: Column, stated: Column, body_lines: Column) -> Column:
    """Front-matter title, else the first level-1 heading, else the file stem."""
    top = F.filter(body_lines, lambda l: l.rlike(_HEADING) & l.rlike(r"\A#(?!#)"))
    first = F.try_element_at(top, F.lit(1))
    return F.coalesce(
        text.present(stated), heading_text(F.regexp_extract(first, _HEADING, 2)), paths.stem(path)
    )


_BLOCK_STATE = (
    "struct<stack:array<string>,open:array<string>,"
    "found:array<struct<id:string,text:string,heading_path:array<string>>>>"
)


def blocks_of(body_lines: Column) -> Column:
    """Canonical blocks of a body, in order: array<struct(id, text, heading_path)>.

    One pass over the lines.  A block id owns the lines since the previous id, blank line or
    heading; the heading stack is cut to ``level - 1`` entries before a heading is added.
    """
    start = F.from_json(F.lit('{"stack":[],"open":[],"found":[]}'), _BLOCK_STATE)
    nothing = F.array().cast("array<string>")

    def state(stack: Column, open_lines: Column, found: Column) -> Column:
        return F.struct(stack.alias("stack"), open_lines.alias("open"), found.alias("found"))

    def step(acc: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, _HEADING, 1))
        stack = F.concat(
            F.slice(acc["stack"], F.lit(1), level - 1),
            F.array(heading_text(F.regexp_extract(line, _HEADING, 2))),
        )
        owned = F.concat(acc["open"], F.array(line))
        ids = F.regexp_extract_all(line, F.lit(provenance.BLOCK_ID), F.lit(1))
        words = text.strip(F.regexp_replace(F.array_join(owned, "\n"), provenance.BLOCK_ID, ""))
        added = F.transform(
            ids,
            lambda i: F.struct(i.alias("id"), words.alias("text"), acc["stack"].alias("heading_path")),
        )
        return (
            F.when(line.rlike(_HEADING), state(stack, nothing, acc["found"]))
            .when(line == "", state(acc["stack"], nothing, acc["found"]))
            .when(
                line.contains("^") & (F.size(ids) > 0),
                state(acc["stack"], nothing, F.concat(acc["found"], added)),
            )
            .otherwise(state(acc["stack"], owned, acc["found"]))
        )

    return F.aggregate(F.transform(body_lines, text.rstrip), start, step)["found"]


def with_lines(files: DataFrame) -> DataFrame:
    """Front-matter and body lines as columns, so that several expressions share them."""
    return files.select(
        "*",
        text.lines(frontmatter.inventory_block(F.col("content"))).alias("_front"),
        text.lines(frontmatter.inventory_body(F.col("content"))).alias("_body"),
    )


def index_pages(files: DataFrame) -> DataFrame:
    """Page rows from (path, content): path, kind, title, migration_status, provenance_schema."""
    parsed = with_lines(provenance.callouts(files))
    front, body = F.col("_front"), F.col("_body")
    return parsed.select(
        "path",
        paths.kind(F.col("path")).alias("kind"),
        title(F.col("path"), frontmatter.inventory_value(front, "title"), body).alias("title"),
        F.col("callout.migration_status").alias("migration_status"),
        F.col("callout.schema").alias("provenance_schema"),
    )


def index_blocks(files: DataFrame) -> DataFrame:
    """Block rows from (path, content); the callout's metadata meets them in the row of their page."""
    body = text.lines(frontmatter.inventory_body(F.col("content")))

    def joined(blocks: Column, known: Column) -> Column:
        def looked_up(metadata: Column) -> Column:
            return text.let(
                F.transform(metadata, lambda m: m["block_id"]),
                lambda ids: F.transform(
                    blocks,
                    lambda b, i: F.struct(
                        i.alias("ordinal"), *[b[key].alias(key) for key in ("id", "text", "heading_path")],
                        F.get(metadata, (F.array_position(ids, b["id"]) - 1).cast("int")).alias("m"),
                    ),
                ),
            )

        return text.let(known, looked_up)

    marked = provenance.callouts(files.where(F.col("content").contains("^")))
    found = marked.select(
        # the outer form keeps Spark from adding filters that would parse every page again
        "path", F.explode_outer(joined(blocks_of(body), provenance.metadata_of(F.col("callout")))).alias("block")
    ).where("block IS NOT NULL").select("path", "block.*")
    return with_defaults(found)


def with_defaults(found: DataFrame) -> DataFrame:
    """Blocks with their callout metadata ``m`` (NULL where there is none) and the defaults of absent entries."""

    def default(key: str) -> Column:
        return F.when(F.coalesce(F.col(f"m.{key}_given"), F.lit(False)), F.col(f"m.{key}")).otherwise("unknown").alias(key)

    return found.select(
        "path", "ordinal", "id", "text", "heading_path", default("status"), default("confidence"),
        F.coalesce("m.sources", F.array().cast("array<string>")).alias("sources"),
        "m.observed", "m.checked", "m.superseded_by", "m.provenance_quality", "m.review_mode",
        "m.evidence_latest", (F.coalesce("m.field_count", F.lit(0)) > 0).alias("has_provenance"),
    )


def index_raw_notes(files: DataFrame) -> DataFrame:
    """Raw-note rows from (path, content): path, title, date, source_type, headings."""
    front, body = F.col("_front"), F.col("_body")

    def field(*keys: str) -> Column:
        return F.coalesce(*[text.present(frontmatter.inventory_value(front, k)) for k in keys])

    return with_lines(files).select(
        "path",
        title(F.col("path"), frontmatter.inventory_value(front, "title"), body).alias("title"),
        field("date", "created").alias("date"),
        field("source_type", "type").alias("source_type"),
        headings(body).alias("headings"),
    )


def summary(pages: DataFrame, raw_notes: DataFrame, blocks: DataFrame, issues: DataFrame) -> DataFrame:
    """The seven inventory counters in one row."""
    by_block = blocks.agg(
        F.count(F.lit(1)).alias("canonical_blocks"),
        F.count_if("has_provenance").alias("blocks_with_provenance"),
        F.count_if(~F.col("has_provenance")).alias("blocks_without_provenance"),
    )
    inferred = pages.where(F.col("migration_status") == vocab.INFERRED_MIGRATION)

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return by_block.select(
        rows(pages).alias("wiki_pages"), rows(raw_notes).alias("raw_notes"), "canonical_blocks",
        "blocks_with_provenance", "blocks_without_provenance",
        rows(inferred).alias("legacy_inferred_pages"), rows(issues).alias("validation_issues"),
    )
