"""Orphans, stubs, loose files and leftovers of the older layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, links, names, paths, text
from ..functions.skew import shuffled
from . import mentions, vault_links


def topic_pages(files: DataFrame) -> DataFrame:
    """Pages exactly two levels below wiki/, without index pages."""
    path = F.col("path")
    return files.where(
        path.rlike(r"\Awiki/[^/]+/[^/]+\.md\z") & ~paths.name(path).isin("index.md", "_index.md")
    )


def orphans(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Pages nobody links to and that link nowhere; ``notes``: path, content.

    Pages saying ``orphan: false`` are exempt and do not lend their stem to links.
    """
    # only texts with the word can hold the flag; the others are not split
    exempt = F.coalesce(F.col("content").contains("orphan"), F.lit(False)) & frontmatter.has_flag(
        text.lines(F.col("content")), "orphan", "false"
    )
    pages = topic_pages(notes).where(~exempt).select("path")
    return unlinked(pages, note_wikilinks(notes), files)


def note_wikilinks(notes: DataFrame) -> DataFrame:
    """(path, target) of the wikilinks that count as relations between notes; a note names each target once.

    The same links as :func:`vault_links.extract` finds, without their lines and places: no text is split.
    """
    scanned = notes.where(paths.is_scanned_page(F.col("path")) & F.col("content").contains("[["))
    targets = F.array_distinct(links.wikilink_targets(F.col("content")))
    return scanned.select("path", F.explode_outer(targets).alias("target")).where(
        F.col("target").isNotNull() & (F.col("target") != "")
        & ~F.col("target").startswith("#") & ~names.is_external(F.col("target"))
    )


def unlinked(pages: DataFrame, wikilinks: DataFrame, files: DataFrame) -> DataFrame:
    """Pages without inbound and without outbound wikilinks."""
    targets = wikilinks.select("target").distinct()
    inbound = vault_links.resolve_to_page(targets, files, pages).select("path").distinct()
    outbound = wikilinks.select("path").distinct()
    return pages.join(shuffled(inbound), "path", "left_anti").join(shuffled(outbound), "path", "left_anti")


def backlinks(wikilinks: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Number of distinct notes linking to each page."""
    edges = wikilinks.distinct()
    resolved = vault_links.resolve_to_page(edges.select("target"), files, pages).withColumnRenamed(
        "path", "page"
    )
    return edges.join(shuffled(resolved), "target").groupBy("page").agg(F.countDistinct("path").alias("sources"))


def word_count(all_lines: Column) -> Column:
    """Prose words of a page: no front matter, headings or lines that only hold a link."""

    def count(lines: Column) -> Column:
        opened = F.coalesce(text.strip(F.get(lines, F.lit(0))) == "---", F.lit(False))
        end = frontmatter.closing_line_number(lines)
        body = F.when(opened & (end == 0), F.array().cast("array<string>")).otherwise(
            F.slice(lines, end + 1, F.size(lines))
        )
        prose = F.filter(
            F.transform(body, text.strip),
            lambda l: (l != "") & ~l.startswith("#") & ~l.rlike(r"(?U)\A(?:[-*+][\s\x1c-\x1f]*)?\[\["),
        )
        return F.aggregate(
            prose, F.lit(0), lambda acc, l: acc + F.size(F.split(l, r"(?U)[\s\x1c-\x1f]+"))
        )

    return text.let(all_lines, count)


def stubs(notes: DataFrame, threshold: int = 5) -> DataFrame:
    """Topic pages with fewer prose words than ``threshold`` and no ``stub: true``."""
    pages = topic_pages(notes).withColumn("_lines", text.lines(F.col("content")))
    return pages.where(~frontmatter.has_flag(F.col("_lines"), "stub", "true")).select(
        "path", word_count(F.col("_lines")).alias("words")
    ).where(F.col("words") < threshold)


def loose_files(files: DataFrame) -> DataFrame:
    """Non-Markdown files of the content trees outside resource folders."""
    path, name = F.col("path"), paths.name(F.col("path"))
    return files.where(
        path.rlike(r"\A(?:raw|wiki|INBOX)/")
        & (F.lower(paths.suffix(path)) != ".md") & ~paths.in_resources(path)
        & ~name.startswith(".") & ~name.startswith("log.jsonl")
    )


def legacy_folders(files: DataFrame) -> DataFrame:
    """Folders named ``converted`` below raw/ with the number of their Markdown files."""
    path, folder = F.col("path"), paths.parent(F.col("path"))
    return files.where(
        path.startswith("raw/") & ~path.rlike(r"/\.[^/]*/") & (paths.name(folder) == "converted")
    ).groupBy(folder.alias("folder")).agg(F.count_if(path.endswith(".md")).alias("md_files"))


def text_mentions(stems: DataFrame, texts: DataFrame) -> DataFrame:
    """Stems that occur in a text as a whole word (optionally followed by ``.md``): stem, path.

    All stems are looked for at once, see :mod:`vaultry.operators.mentions`; no stem meets a text it does not stand in.
    """
    return mentions.mentioned(texts, stems).distinct()
