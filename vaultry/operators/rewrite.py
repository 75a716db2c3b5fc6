"""Rewrites of note texts as plan rows: path, hash_before, content, changes.

Every rewrite is a column expression; nothing is written until :mod:`vaultry.sinks.files` applies
a plan, which checks ``hash_before``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, links, names, paths, text
from ..functions.skew import shuffled
from .ledger import content_hash

# A line worth dropping once its link is gone, and raw-path references.
_BARE = r"""(?U)\A\s*(?:[-*+]|\d+\.)?\s*(?:""|''|“”|‘’)?\s*\z"""
_RAW = r"raw/[^\n`\[\]]+?\.md"


def quoted(c: Column) -> Column:
    """Regex that matches a text literally."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def literal(c: Column) -> Column:
    """Replacement that stands for a text literally."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def _pattern(before: str, target: Column, after: str) -> Column:
    return F.concat(F.lit(before), quoted(target), F.lit(after))


def _wiki(embed: bool) -> str:
    return r"!\[\[" if embed else r"(?<!!)\[\["


def _md(embed: bool) -> str:
    return r"!\[([^\]]*)\]\(" if embed else r"(?<!!)\[([^\]]*)\]\("


_HEADING, _ALIAS = r"( ?#[^|\\\]]*)?", r"(?:\\?\|([^\]\n]*))?\]\]"
_MD_END = r"(?: ?#[^)]*)?\)"


def replaced_wikilink(content: Column, old: Column, new: Column, embed: bool = False) -> Column:
    """Target replaced; alias and anchor stay."""
    lead = r"(?<=!)\[\[" if embed else r"(?<!!)\[\["
    return F.regexp_replace(
        content, _pattern(lead, old, r"(?=[\]|#\n]| #)"), F.concat(F.lit("[["), literal(new))
    )


def replaced_mdlink(content: Column, old: Column, new: Column, embed: bool = False) -> Column:
    mark = "!" if embed else ""
    return F.regexp_replace(
        content, _pattern(_md(embed), old, _MD_END), F.concat(F.lit(f"{mark}[$1]("), literal(new), F.lit(")"))
    )


def marked_broken(content: Column, target: Column) -> Column:
    """``[[t|text]]`` becomes ``[[t|(broken link) text]]``."""
    head = F.concat(F.lit("[["), literal(target), F.lit("$1|(broken link) "))
    aliased = F.regexp_replace(
        content, _pattern(r"(?<!!)\[\[", target, _HEADING + r"\\?\|([^\]\n]*)\]\]"), F.concat(head, F.lit("$2]]"))
    )
    plain = _pattern(r"(?<!!)\[\[", target, r"( ?#[^|\\\]]*)?\]\]")
    return F.regexp_replace(aliased, plain, F.concat(head, literal(target), F.lit("]]")))


def placeholder(content: Column, target: Column, embed: bool = False) -> Column:
    """Link pointed at the note that collects broken links."""
    aliased = F.regexp_replace(
        content, _pattern(_wiki(embed), target, _HEADING + r"\\?\|([^\]\n]*)\]\]"), F.lit("[[broken-link|$2]]")
    )
    return F.regexp_replace(
        aliased, _pattern(_wiki(embed), target, r"( ?#[^|\\\]]*)?\]\]"),
        F.concat(F.lit("[[broken-link|"), literal(target), F.lit("]]")),
    )


def delinked_wikilink(content: Column, target: Column, embed: bool = False) -> Column:
    """Link replaced by its alias, else by the file name (embeds keep the extension)."""
    aliased = F.regexp_replace(
        content, _pattern(_wiki(embed), target, r"(?: ?#[^|\\\]]*)?\\?\|([^\]]*)\]\]"), F.lit("$1")
    )
    shown = paths.name(target) if embed else paths.stem(target)
    return F.regexp_replace(aliased, _pattern(_wiki(embed), target, r"(?: ?#[^|\\\]]*)?\]\]"), literal(shown))


def delinked_mdlink(content: Column, target: Column, embed: bool = False) -> Column:
    named = F.regexp_replace(
        content, _pattern(_md(embed).replace("*)", "+)"), target, _MD_END), F.lit("$1")
    )
    return F.regexp_replace(named, _pattern(_md(embed), target, _MD_END), literal(paths.name(target)))


def _deleted(content: Column, link: Column, opening: Column) -> Column:
    """Link removed; a line left bare goes with it; line ends of other lines stay.  No link is in a line without its ``opening``."""
    both = F.concat(F.lit(" "), link, F.lit(" "))
    single = F.concat(F.lit(" ?"), link, F.lit(" ?"))
    rows = F.regexp_extract_all(content, F.lit(r"[^\n]*\n|[^\n]+\z"), F.lit(0))

    def line(l: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(l, both, F.lit(" ")), single, F.lit(""))
        done = text.let(
            cut, lambda c: F.when((c != l) & F.regexp_replace(c, r"[\r\n]+\z", "").rlike(_BARE), "").otherwise(c)
        )
        return F.when(l.contains(opening), done).otherwise(l)

    return F.array_join(F.transform(rows, line), "")


def deleted_wikilink(content: Column, target: Column, embed: bool = False) -> Column:
    link = _pattern(_wiki(embed), target, r"(?: ?#[^|\\\]]*)?(?:\\?\|[^\]]*)?\]\]")
    return _deleted(content, link, F.concat(F.lit("[["), target))


def deleted_mdlink(content: Column, target: Column, embed: bool = False) -> Column:
    return _deleted(content, _pattern(_md(embed), target, _MD_END), F.concat(F.lit("]("), target))


def fixed_links(notes: DataFrame, fixes: DataFrame) -> DataFrame:
    """Apply suggested wikilink fixes (path, target, suggested_fix) to notes (path, content); links without a suggestion are deleted.

    Distinct fixes of one note are applied one after the other inside its row, the deletions after them; ``changes`` counts
    replaced links.  The number of fixes per note is bounded by the links the note holds.
    """
    fixed = F.col("suggested_fix").isNotNull()
    per_note = fixes.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(fixed, F.struct("target", "suggested_fix")))).alias("fixes"),
        F.array_sort(F.collect_set(F.when(~fixed, F.col("target")))).alias("gone"),
    )

    def replaced(acc: Column, fix: Column) -> Column:
        new = replaced_wikilink(acc, fix["target"], fix["suggested_fix"])
        return F.when(_may_be_replaced(acc, fix["target"]), new).otherwise(acc)

    def deleted(acc: Column, target: Column) -> Column:
        return F.when(acc.contains(F.concat(F.lit("[["), target)), deleted_wikilink(acc, target)).otherwise(acc)

    def counted(acc: Column, fix: Column) -> Column:
        pattern = _pattern(r"(?<!!)\[\[", fix["target"], r"(?=[\]|#\n]| #)")
        return F.struct(
            replaced(acc["text"], fix).alias("text"), (acc["changes"] + F.regexp_count(acc["text"], pattern)).alias("changes")
        )

    new = F.aggregate("gone", F.aggregate("fixes", F.col("content"), replaced), deleted)
    # a row of an array: the filter on changed texts would make a plain column's text a second time
    done = notes.join(shuffled(per_note), "path").select(*notes.columns, "fixes", F.explode_outer(F.array(new)).alias("_text"))
    # of its own, so that who wants no count pays for none
    changes = F.aggregate("fixes", F.struct(F.col("content").alias("text"), F.lit(0).alias("changes")), counted)["changes"]
    return plan(done, F.col("_text"), changes)


def _may_be_replaced(content: Column, target: Column) -> Column:
    """Whether the target opens a link before one of the endings of :func:`replaced_wikilink`; no pattern is compiled for the others."""
    head = F.concat(F.lit("[["), target)
    ends = [content.contains(F.concat(head, F.lit(end))) for end in ("]", "|", "#", " #", "\n")]
    return content.contains(head) & reduce(or_, ends)


def plan(notes: DataFrame, new_content: Column, changes: Column | None = None) -> DataFrame:
    """Plan rows for notes whose text changes."""
    rows = notes.select(
        "path", content_hash(F.col("content")).alias("hash_before"), F.col("content").alias("_old"),
        new_content.alias("content"), (F.lit(1) if changes is None else changes).alias("changes"),
    )
    return rows.where("content <> _old").drop("_old")


def curly_renames(files: DataFrame) -> DataFrame:
    """Renames of pages with curly quotes in their stem; taken names are left out."""
    wanted = files.where(
        paths.is_scanned_page(F.col("path")) & names.has_curly(paths.stem(F.col("path")))
    ).select(
        F.col("path").alias("old"),
        F.concat(
            paths.parent(F.col("path")), F.lit("/"), names.straight_quotes(paths.name(F.col("path")))
        ).alias("new"),
    )
    free = wanted.join(files.select(F.col("path").alias("new")), "new", "left_anti")
    return free.groupBy("new").agg(F.min("old").alias("old")).select("old", "new")


def straightened_links(content: Column) -> Column:
    """Curly quotes inside link targets made straight; other text stays."""
    for pattern in (links.WIKILINK, links.EMBED, links.MDLINK, links.MDIMAGE):
        raws = F.array_distinct(
            F.filter(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), names.has_curly)
        )
        content = F.aggregate(raws, content, _straightener(pattern))
    return content


def _straightener(pattern: str):
    def step(acc: Column, raw: Column) -> Column:
        target = F.regexp_extract(raw, pattern, 1)
        fixed = F.replace(raw, target, names.straight_quotes(target))
        return F.when(names.is_external(target), acc).otherwise(F.replace(acc, raw, fixed))

    return step


def wrapped_raw_references(content: Column) -> Column:
    """raw/ paths made links: in backticks anywhere, bare at the start of bullets and source lines.

    Front matter and fenced blocks are left alone; only the fence character that opened a block
    closes it.
    """
    def wrap(line: Column) -> Column:
        ticked = F.regexp_replace(line, f"`({_RAW})`", "[[$1]]")
        bullet = F.regexp_replace(ticked, rf"(?U)\A(\s*[-*+]\s+)({_RAW})(?=\s|\z)", "$1[[$2]]")
        source = F.regexp_replace(ticked, rf"(?U)\A(\s*\*?Source:\*?\s+)({_RAW})(?=\s|\z|\*)", "$1[[$2]]")
        return F.when(ticked.rlike(r"(?U)\A\s*[-*+]\s"), bullet).otherwise(source)

    def lines_of(rows: Column) -> Column:
        return text.let(
            frontmatter.closing_line_number(rows),
            lambda end: F.concat_ws(
                "\n", F.slice(rows, F.lit(1), end), outside(F.slice(rows, end + 1, F.size(rows)))
            ),
        )

    def outside(body: Column) -> Column:
        # fence lines alone are folded over: the fence that is open after each of them
        marks = F.filter(
            F.transform(body, lambda l, i: F.struct(i.alias("i"), F.regexp_extract(l, r"(?U)\A\s*(```|~~~)", 1).alias("m"))),
            lambda e: e["m"] != "",
        )
        return text.let(text.let(marks, open_spans), lambda spans: masked(body, spans))

    def open_spans(marks: Column) -> Column:
        # a fence is closed by the next fence line of its own character; spans hold first and last line
        nothing = F.lit(None).cast("int")
        start = F.struct(
            F.lit("").alias("fence"), nothing.alias("from"), F.array().cast("array<struct<a:int,b:int>>").alias("spans")
        )

        def step(acc: Column, e: Column) -> Column:
            opens, closes = acc["fence"] == "", acc["fence"] == e["m"]
            return F.struct(
                F.when(opens, e["m"]).when(closes, "").otherwise(acc["fence"]).alias("fence"),
                F.when(opens, e["i"]).when(closes, nothing).otherwise(acc["from"]).alias("from"),
                F.when(closes, F.concat(acc["spans"], F.array(F.struct(acc["from"].alias("a"), e["i"].alias("b")))))
                .otherwise(acc["spans"]).alias("spans"),
            )

        def unclosed(end: Column) -> Column:
            rest = F.array(F.struct(end["from"].alias("a"), F.lit(2_000_000_000).alias("b")))
            return F.when(end["fence"] != "", F.concat(end["spans"], rest)).otherwise(end["spans"])

        return F.aggregate(marks, start, step, unclosed)

    def masked(body: Column, spans: Column) -> Column:
        # lines between the spans are rewritten, span by span, so every line is looked at once
        n = F.size(spans)

        def between(k: Column) -> Column:
            first = F.coalesce(F.get(spans, k - 1)["b"] + 1, F.lit(0))
            stop = F.coalesce(F.get(spans, k)["a"], F.size(body))
            last = F.least(F.coalesce(F.get(spans, k)["b"].cast("bigint") + 1, F.lit(0)), F.size(body).cast("bigint")).cast("int")
            free = F.transform(F.slice(body, first + 1, F.greatest(stop - first, F.lit(0))), wrap)
            kept = F.slice(body, stop + 1, F.greatest(last - stop, F.lit(0)))
            return F.concat(free, kept)

        return F.flatten(F.transform(F.sequence(F.lit(0), n), between))

    return F.when(
        content.contains("raw/"), text.let(F.split(content, "\n", -1), lines_of)
    ).otherwise(content)


def with_key(content: Column, key: str, value: str) -> Column:
    """Front-matter line ``key: value`` added; unclosed blocks stay untouched."""
    entry = f"{key}: {value}\n"

    def add(c: Column) -> Column:
        rows = text.lines(c)
        closed = frontmatter.closing_line_number(rows) > 0
        opened = F.coalesce(text.strip(F.get(rows, F.lit(0))) == "---", F.lit(False))
        inserted = F.regexp_replace(c, r"(?s)\A([^\n]*\n(?:.*?\n)??)([ \t]*(?:---|\.\.\.)[ \t]*(?:\r?\n|\z))", "$1" + entry + "$2")
        return (
            F.when(frontmatter.has_flag(rows, key, value), c).when(closed, inserted)
            .when(opened, c).otherwise(F.concat(F.lit(f"---\n{entry}---\n"), c))
        )

    return text.let(content, add)


def without_key(content: Column, key: str, value: str) -> Column:
    """Front-matter lines ``key: value`` removed."""
    pattern = rf"(?U)\A\s*{key}\s*:\s*{value}\s*\z"

    def cut(c: Column) -> Column:
        rows = F.split(c, "\n", -1)
        return text.let(
            frontmatter.closing_line_number(text.lines(c)),
            lambda end: F.when(end == 0, c).otherwise(
                F.array_join(
                    F.filter(rows, lambda l, i: ~((i > 0) & (i < end) & l.rlike(pattern))), "\n"
                )
            ),
        )

    return text.let(content, cut)


def plain_references_linked(content: Column, stem: Column) -> Column:
    """Plain mentions of a page made links; links, inline code and front matter stay."""
    # fixed value: links and inline code
    skip = r"\[\[[^\]\n]+\]\]|\[[^\]\n]*\]\([^)\n]*\)|`[^`\n]*`"
    mention = F.concat(F.lit(r"(?U)(?<!\w)"), quoted(stem), F.lit(r"(?:\.md)?(?!\w)"))
    link = F.concat(F.lit("[["), literal(stem), F.lit("]]"))

    def go(c: Column) -> Column:
        rows = F.split(c, "\n", -1)
        return text.let(frontmatter.closing_line_number(text.lines(c)), lambda end: text.let(rows, lambda r: F.concat_ws(
            "\n", F.slice(r, F.lit(1), end), F.transform(F.slice(r, end + 1, F.size(r)), line)
        )))

    def line(l: Column) -> Column:
        safe, kept = F.split(l, skip, -1), F.regexp_extract_all(l, F.lit(skip), F.lit(0))
        changed = F.zip_with(
            F.transform(safe, lambda s: F.regexp_replace(s, mention, link)), kept,
            lambda s, k: F.concat(F.coalesce(s, F.lit("")), F.coalesce(k, F.lit(""))),
        )
        return F.when(~l.contains(stem), l).otherwise(F.array_join(changed, ""))

    return text.let(content, go)
