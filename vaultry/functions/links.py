"""Links inside Markdown text.

Every quantified group is possessive: nothing after it needs backtracking, and Java then loops
instead of recursing, so very long lines cannot exhaust the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, text

# Link syntax. A lone "]" or a backslash not before "|" may be part of a target.
_WIKI_TARGET = r"((?:[^\]|\n\\]++|\\(?!\|)|\](?!\]))++)"
_MD_TARGET = r"((?:[^()#\n]++|\([^()\n]*+\))++)(?:#[^)]*+)?\)"
_MARKED = r"(?!\\?\|\(broken link\))"
# The bracket comes first and what stands before it is looked at then: a find passes other characters quickly.
_OPEN, _OPEN_MD = r"\[\[(?<!!\[\[)", r"\[(?<!!\[)"
WIKILINK = _OPEN + _WIKI_TARGET
LIVE_WIKILINK = WIKILINK + _MARKED
EMBED = r"!\[\[" + _WIKI_TARGET
MDLINK = _OPEN_MD + r"[^\]]*+\]\(" + _MD_TARGET
MDIMAGE = r"!\[[^\]]*+\]\(" + _MD_TARGET
# LIVE_WIKILINK for a whole text: the target ends at every break of a line, so no text need be split.
_LIVE_IN_TEXT = _OPEN + r"((?:[^\]|\\\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]++|\\(?!\|)|\](?!\]))++)" + _MARKED

# Looser reading used when whole notes are related to pages by title.
TITLE_LINK = r"\[\[([^\]|#]++)(?:#[^\]|]++)?(?:\|[^\]]++)?\]\]"


#: Links of a line in reading order: type, opening, pattern, whether the match is the opening and the target.
_KINDS = [
    ("wikilink", "[[", LIVE_WIKILINK, True), ("image", "![[", EMBED, True), ("markdown", "](", MDLINK, False), ("image", "](", MDIMAGE, False),
]


def in_line(line: Column, images: bool) -> list[Column]:
    """Matches in a line: wikilinks, embeds, Markdown links, Markdown images; embeds and images only with ``images``."""
    none = F.array().cast("array<string>")
    return [
        # skipped without a regex when the line lacks the opening
        F.when(line.contains(opening), F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).otherwise(none)
        if images or kind != "image" else none for kind, opening, pattern, _ in _KINDS
    ]


def kind_and_target(raw: Column, position: Column, counts: list[Column]) -> tuple[Column, Column]:
    """Type and target of a match at ``position`` of a line's matches; ``counts``: how many :func:`in_line` found of each."""
    kind, target, end = None, None, F.lit(0)
    for (name, opening, pattern, plain), n in zip(_KINDS, counts):
        end = end + n
        value = F.substring(raw, len(opening) + 1, 1 << 30) if plain else F.regexp_extract(raw, pattern, 1)
        here = position < end
        kind = F.when(here, name) if kind is None else kind.when(here, name)
        target = F.when(here, value) if target is None else target.when(here, value)
    return kind, text.strip(target)


def in_lines(all_lines: Column, images: bool) -> Column:
    """Links in reading order as one array: line, position, type, raw, target."""

    def of(line: Column, at: Column) -> Column:
        found = in_line(line, images)

        def link(raw: Column, position: Column) -> Column:
            kind, target = kind_and_target(raw, position, [F.size(raws) for raws in found])
            return F.struct(
                (at + 1).alias("line"), position.alias("position"), kind.alias("type"), raw.alias("raw"), target.alias("target")
            )

        return F.transform(F.flatten(F.array(*found)), link)

    return F.flatten(F.transform(all_lines, of))


def wikilink_targets(content: Column) -> Column:
    """Targets of the wikilinks that :func:`in_line` finds, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(content, F.lit(_LIVE_IN_TEXT), F.lit(1)), text.strip)


def title_targets(content: Column) -> Column:
    """Targets under the looser reading, stripped, in order, repeats kept."""
    return F.transform(F.regexp_extract_all(content, F.lit(TITLE_LINK), F.lit(1)), text.strip)


def file_targets(content: Column, front_lines: Column) -> Column:
    """Everything a note points at: wikilinks and embeds, Markdown links, ``source:`` entries."""
    wiki = F.regexp_extract_all(content, F.lit(r"\[\[" + _WIKI_TARGET), F.lit(1))
    md = F.regexp_extract_all(content, F.lit(r"\[[^\]\n]*+\]\(" + _MD_TARGET), F.lit(1))
    source = rf"(?U)\A{text.SPACE}*source{text.SPACE}*:{text.SPACE}*(.+?){text.SPACE}*(?:#.*)?\z"
    sources = F.transform(
        F.filter(front_lines, lambda line: line.rlike(source)),
        lambda line: F.regexp_extract(line, source, 1),
    )
    return F.concat(wiki, md, sources)


def cleaned_target(c: Column, cut_anchor: bool = True) -> Column:
    """Brackets, quotes and percent-escapes removed; NULL for external or empty targets."""
    # every step mentions its input once, so the expression stays small inside lambdas
    c = text.strip(c)
    c = F.regexp_replace(c, rf"(?sU)\A<{text.SPACE}*(.*?){text.SPACE}*>\z", "$1")
    c = F.regexp_replace(c, rf"""(?sU)\A(["']){text.SPACE}*(.*?){text.SPACE}*\1\z""", "$2")
    c = F.translate(paths.url_decoded(c), "\\", "/")
    if cut_anchor:
        c = F.regexp_replace(c, r"(?s)[#?].*\z", "")
    return text.present(F.regexp_replace(c, r"(?si)\A(?:#|[a-z][a-z0-9+.-]*:).*\z", ""))
