"""Dates of raw notes and of the pages that cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, frontmatter, paths, skew, text, vocab

# Sections, bullets and links of source lines.
_SECTION = r"(?iU)\A#{2,}[\s\x1c-\x1f]+Sources[\s\x1c-\x1f]*\z"
_HEADING = r"(?U)\A#{1,6}[\s\x1c-\x1f]+\S"
_BULLET = r"(?U)\A[\s\x1c-\x1f]*[-*+][\s\x1c-\x1f]+\S"
_LINK = r"\[\[([^\]]+)\]\]"
_ITALIC = r"\*([^*]+)\*"
_BARE = r"(?U)(raw/[^\s\]|*]+(?:\s+[^\s\]|*]+)*?\.md)"

_FIELDS = sorted(
    {*vocab.CONTENT_DATE_FIELDS, *vocab.EDIT_DATE_FIELDS, *vocab.CAPTURE_DATE_FIELDS,
     *vocab.SYNC_DATE_FIELDS, "date_confidence"}
)


def is_content_page(path: Column) -> Column:
    return path.rlike(r"\A(?:wiki|raw)/") & ~paths.name(path).isin("_index.md", "index.md")


def date_fields(notes: DataFrame) -> DataFrame:
    """Notes (path, content) plus ``fields``: struct of the front-matter values dates come from."""
    block = notes.withColumn("_block", text.lines(frontmatter.dates_block(F.col("content"))))
    return block.withColumn(
        "fields",
        F.struct(*[frontmatter.dates_value(F.col("_block"), k).alias(k) for k in _FIELDS]),
    ).drop("_block")


def raw_dates(notes: DataFrame) -> DataFrame:
    """Date of every raw note: path, date, date_span, date_confidence, mixed_era; NULLs if none.

    File name, then fields (an own ``date`` is ignored, it is about to be written), then the stem,
    then prose, then the sync stamp.
    """
    def field(key: str) -> Column:
        return F.col(f"fields.{key}")

    rows = date_fields(notes)
    named = dates.from_file_name(F.col("path"))
    # a year in a parent folder counts like a content field
    folder = F.when(F.col("path").rlike(dates.YEAR), dates.normal(F.col("path"))["date"])
    synced = F.coalesce(*[dates.normal(field(k))["date"] for k in vocab.SYNC_DATE_FIELDS])
    other = F.coalesce(
        dates.dated(folder, "high"),
        dates.from_fields(field, skip_date=True),
        dates.dated(dates.normal(paths.stem(F.col("path")))["date"], "medium"),
        dates.from_prose(frontmatter.dates_body(F.col("content"))),
        dates.dated(synced, "low"),
    )
    found = rows.select("path", named.alias("_named"), F.when(named.isNull(), other).alias("_other"))
    return found.select(
        "path", F.coalesce("_named.date", "_other.date").alias("date"),
        F.coalesce("_named.span", F.substring("_other.date", 1, 4)).alias("date_span"),
        F.coalesce("_named.confidence", "_other.confidence").alias("date_confidence"),
        F.coalesce(F.col("_named.span").contains(dates.SPAN_DASH), F.lit(False)).alias("mixed_era"),
    )


def _raw_target(line: Column) -> Column:
    """The raw/ path a source line names: link, italics or bare."""
    targets = F.transform(
        F.regexp_extract_all(line, F.lit(_LINK), F.lit(1)), lambda t: text.strip(F.substring_index(t, "|", 1))
    )
    linked = F.get(F.filter(targets, lambda t: t.startswith("raw/")), F.lit(0))
    italic = text.strip(F.regexp_extract(line, _ITALIC, 1))
    return F.coalesce(
        linked, F.when(italic.startswith("raw/"), italic), text.strip(text.find(line, _BARE, 1))
    )


def source_lines(pages: DataFrame) -> DataFrame:
    """Lines of the Sources section that may carry a date: path, line, text, target."""
    def section(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda l: l.rlike(_SECTION)), F.lit(True)).cast("int")

        def body(at: Column) -> Column:
            rest = F.slice(lines, at + 1, F.size(lines))
            ends = F.transform(rest, lambda l: l.rlike(_HEADING) & ~l.rlike(_SECTION))
            return text.let(
                F.array_position(ends, F.lit(True)).cast("int"),
                lambda e: F.slice(rest, F.lit(1), F.when(e > 0, e - 1).otherwise(F.size(rest))),
            )

        return text.let(F.nullif(start, F.lit(0)), body)

    rows = pages.where(F.lower("content").contains("sources")).select(
        "path", F.posexplode_outer(text.let(text.lines(F.col("content")), section)).alias("line", "text")
    ).where("line IS NOT NULL").withColumn("target", _raw_target(F.col("text")))
    return rows.where(
        F.col("target").isNotNull() | F.col("text").contains("raw/") | F.col("text").rlike(_BULLET)
    )


def page_source_dates(pages: DataFrame, raw_notes: DataFrame) -> DataFrame:
    """Dated sources of pages: path, line, date, confidence.

    A full date on the line wins; then what the raw file says (its name, the path, its fields);
    then a month or year on the line.  ``raw_notes``: path, fields (see :func:`date_fields`).
    """
    lines = source_lines(pages)
    truncated = F.col("target").endswith("...")
    known = raw_notes.select(F.col("path").alias("_raw"), "fields")
    md = F.when(F.lower("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md")))
    exact = lines.where("target LIKE 'raw/%'").select("target", md.alias("_raw")).distinct().join(known, "_raw")
    # a shortened name stands for the first file of its folder that continues it: the next path in order, if any does
    cut = lines.where(F.col("target").startswith("raw/") & truncated).select(
        "target", F.regexp_replace("target", r"\.\.\.\z", "").alias("start")
    ).distinct()
    # paths of a folder stand together when its separator sorts before all else
    def ordered(path: Column) -> Column:
        return F.concat(paths.parent(path), F.lit("\u0000"), paths.name(path))

    pages_only = raw_notes.where(F.lower("path").endswith(".md")).select(F.col("path").alias("_raw"), ordered(F.col("path")).alias("key"))
    keyed = cut.where(~F.col("start").endswith("/")).withColumn("start", ordered(F.col("start"))).unionByName(
        cut.where(F.col("start").endswith("/")).withColumn("start", F.concat(F.regexp_replace("start", r"/+\z", ""), F.lit("\u0000")))
    )
    nearest = skew.first_from(keyed.select("start"), pages_only.select("key")).where(F.startswith("key", "start"))
    continued = keyed.join(nearest, "start").join(pages_only, "key").select("target", "_raw").join(known, "_raw")
    files = exact.unionByName(continued.select("_raw", "target", "fields"))
    joined = lines.join(files, "target", "left")

    def field(key: str) -> Column:
        return F.col(f"fields.{key}")

    whole = text.find(F.col("text"), dates.ISO_WORD, 0)
    file_name = F.when(F.col("target").startswith("raw/"), F.coalesce("_raw", "target"))
    named = dates.from_file_name(file_name)
    link_named = dates.from_file_name(F.when(file_name.isNotNull(), F.col("target")))
    in_path = F.when(
        file_name.isNotNull() & F.col("target").rlike(dates.YEAR), dates.normal(F.col("target"))["date"]
    )
    best = F.coalesce(
        dates.dated(whole, "high"), dates.dated(named["date"], "high"),
        dates.dated(link_named["date"], "high"), dates.dated(in_path, "high"),
        dates.from_fields(field), dates.dated(dates.normal(F.col("text"))["date"], "high"),
    )
    return joined.withColumn("_best", best).where("_best IS NOT NULL").select(
        "path", "line", F.col("_best.date").alias("date"), F.col("_best.confidence").alias("confidence")
    )


def page_dates(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Date of every page: newest source, span of years, best confidence at the newest date."""
    def rank(c: Column) -> Column:
        out = F.lit(0)
        for word, points in vocab.DATE_CONFIDENCE_RANK.items():
            out = F.when(c == word, points).otherwise(out)
        return out

    best = sources.groupBy("path").agg(
        F.max(F.struct("date", rank(F.col("confidence")).alias("rank"), "confidence")).alias("latest"),
        F.min("date").alias("earliest"),
    )
    title_date = F.when(
        paths.stem(F.col("path")).rlike(dates.YEAR), dates.normal(paths.stem(F.col("path")))["date"]
    )
    joined = pages.select("path").join(best, "path", "left").withColumn("_title", title_date)
    last = F.substring(F.coalesce("latest.date", "_title"), 1, 4)
    first = F.substring(F.coalesce("earliest", "_title"), 1, 4)
    return joined.select(
        "path", F.coalesce("latest.date", "_title").alias("date"),
        F.when(first == last, last).otherwise(F.concat(first, F.lit(dates.SPAN_DASH), last)).alias("date_span"),
        F.coalesce("latest.confidence", F.when(F.col("_title").isNotNull(), "medium")).alias("date_confidence"),
        F.coalesce(first != last, F.lit(False)).alias("mixed_era"),
    )


def statistics(dated: DataFrame) -> DataFrame:
    """Counts per scope (raw / wiki) and confidence; ``none`` for undated pages."""
    return dated.groupBy(
        F.substring_index("path", "/", 1).alias("scope"),
        F.coalesce("date_confidence", F.lit("none")).alias("confidence"),
    ).agg(F.count(F.lit(1)).alias("pages"), F.count_if("mixed_era").alias("mixed_era"))


def undated(dated: DataFrame) -> DataFrame:
    return dated.where("date IS NULL").select("path")


def upserted(content: Column, date: Column, span: Column, confidence: Column) -> Column:
    """Text with the managed keys written into its front matter (created when missing)."""
    fresh = F.concat(
        F.lit("date: "), date, F.lit("\ndate_span: "), span, F.lit("\ndate_confidence: "), confidence
    )

    def write(whole: Column) -> Column:
        kept = frontmatter.without_keys(
            text.lines(F.regexp_replace(frontmatter.dates_block(whole), r"\A\n+|\n+\z", "")),
            vocab.MANAGED_DATE_KEYS + vocab.LEGACY_DATE_KEYS,
        )
        inside = F.concat(
            F.lit("---\n"), F.array_join(F.concat(kept, F.array(fresh)), "\n"), F.lit("\n---"),
            frontmatter.dates_body(whole),
        )
        closed = whole.startswith("---") & (F.locate("\n---", whole, 4) > 0)
        return F.when(closed, inside).otherwise(
            F.concat(F.lit("---\n"), fresh, F.lit("\n---\n"), whole)
        )

    return text.let(content, write)


def reverted(content: Column) -> Column:
    """Text without the managed keys."""

    def write(whole: Column) -> Column:
        closed = whole.startswith("---") & (F.locate("\n---", whole, 4) > 0)
        kept = frontmatter.without_keys(
            text.lines(F.regexp_replace(frontmatter.dates_block(whole), r"\A\n|\n+\z", "")),
            vocab.MANAGED_DATE_KEYS + vocab.LEGACY_DATE_KEYS,
        )
        return F.when(
            closed,
            F.concat(F.lit("---\n"), F.array_join(kept, "\n"), F.lit("\n---"), frontmatter.dates_body(whole)),
        ).otherwise(whole)

    return text.let(content, write)
