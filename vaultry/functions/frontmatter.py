"""The readings of front matter.

Different consumers read the leading ``---`` block differently, and results depend on it, so each
reading is a function of its own.

==========  ==========================================================================
inventory   LF only, first closing ``---``/``...`` line that LF follows
lines       any line break, closing ``---``/``...``; unclosed means none
dates       begins with ``---``, ends at the first LF ``---``; keys in lower case
flags       like lines, but an unclosed block reaches to the end of the text
==========  ==========================================================================
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .text import SPACE

# Fixed value: the block that the inventory reads.
_INVENTORY = r"(?s)\A---\n(.*?)\n(?:---|\.\.\.)\n"
# A line that closes a block, blanks around it.
_RULE = rf"(?U)\A{SPACE}*+(?:---|\.\.\.){SPACE}*+\z"


def _none() -> Column:
    return F.array().cast("array<string>")


# inventory reading -----------------------------------------------------------------------------
def inventory_block(content: Column) -> Column:
    return F.regexp_extract(content, _INVENTORY, 1)


def inventory_body(content: Column) -> Column:
    return F.regexp_replace(content, _INVENTORY, "")


def inventory_value(block_lines: Column, key: str) -> Column:
    """Last value of ``key``; surrounding quote characters removed; NULL when absent."""
    head = rf"(?U)\A{SPACE}*{re.escape(key)}{SPACE}*:"
    hits = F.filter(block_lines, lambda line: line.rlike(head))
    value = text.strip(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), head, ""))
    return F.regexp_replace(value, r"""\A["']+|["']+\z""", "")


def inventory_map(content: Column) -> Column:
    """All scalar entries as a map; the last of equal keys wins."""
    usable = F.filter(
        text.lines(inventory_block(content)),
        lambda line: line.contains(":") & ~text.lstrip(line).startswith("#"),
    )
    pairs = F.transform(
        usable,
        lambda line: F.struct(
            text.strip(F.substring_index(line, ":", 1)).alias("key"),
            F.regexp_replace(
                text.strip(F.regexp_replace(line, r"(?s)\A[^:]*:", "")), r"""\A["']+|["']+\z""", ""
            ).alias("value"),
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]),
    )
    return F.map_from_entries(last)


# line reading ----------------------------------------------------------------------------------
def _closing(all_lines: Column) -> Column:
    """0-based index of the closing line, NULL without a closed leading block."""
    opened = text.strip(F.get(all_lines, F.lit(0))) == "---"
    # most lines hold no rule and need no pattern
    is_rule = F.transform(
        all_lines, lambda line, i: (i > 0) & (line.contains("---") | line.contains("...")) & line.rlike(_RULE)
    )
    found = text.let(F.array_position(is_rule, F.lit(True)), lambda at: F.when(at > 0, at - 1))
    return F.when(opened, found)


def closed_lines(all_lines: Column) -> Column:
    """Lines between the rules; empty when the block is missing or unclosed."""
    def cut(lines: Column) -> Column:
        return text.let(
            _closing(lines).cast("int"),
            lambda end: F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0))),
        )

    return F.coalesce(text.let(all_lines, cut), _none())


def closing_line_number(all_lines: Column) -> Column:
    """1-based number of the closing rule, 0 when there is none."""
    return F.coalesce(text.let(all_lines, _closing) + 1, F.lit(0)).cast("int")


def has_flag(all_lines: Column, key: str, value: str) -> Column:
    """True when the block (unclosed: the whole text) holds the line ``key: value``."""
    pattern = rf"(?U)\A{SPACE}*{re.escape(key)}{SPACE}*:{SPACE}*{re.escape(value)}{SPACE}*\z"

    def found(lines: Column) -> Column:
        opened = F.coalesce(text.strip(F.get(lines, F.lit(0))) == "---", F.lit(False))
        end = F.coalesce(_closing(lines), F.size(lines)).cast("int")
        inside = F.slice(lines, F.lit(2), F.greatest(end - 1, F.lit(0)))
        return opened & F.coalesce(F.exists(inside, lambda line: line.rlike(pattern)), F.lit(False))

    return text.let(all_lines, found)


def says_ingest_false(front_lines: Column) -> Column:
    # fixed value: the line that refuses ingestion
    pattern = rf"""(?iU)\A{SPACE}*ingest{SPACE}*:{SPACE}*(?:"false"|'false'|false){SPACE}*(?:#.*)?\z"""
    return F.exists(front_lines, lambda line: line.rlike(pattern))


# dates reading ---------------------------------------------------------------------------------
def _date_end(content: Column) -> Column:
    """1-based position of the line break before the closing rule, 0 when unclosed."""
    return F.when(content.startswith("---"), F.locate("\n---", content, 4)).otherwise(0)


def dates_block(content: Column) -> Column:
    end = _date_end(content)
    return F.when(end > 0, F.substring(content, F.lit(4), end - 4)).otherwise("")


def dates_body(content: Column) -> Column:
    """Text after the closing rule; the whole text when there is no closed block."""
    end = _date_end(content)
    return F.when(end > 0, F.substring(content, end + 4, F.length(content))).otherwise(content)


def dates_value(block_lines: Column, key: str) -> Column:
    """Last value of a key compared in lower case; quotes kept; NULL when absent or empty."""
    head = rf"(?iU)\A{re.escape(key)}{SPACE}*:"
    hits = F.filter(block_lines, lambda line: line.rlike(head))
    return text.present(text.strip(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), head, "")))


def without_keys(block_lines: Column, keys: list[str]) -> Column:
    pattern = rf"(?U)\A(?:{'|'.join(re.escape(k) for k in keys)}){SPACE}*:"
    return F.filter(block_lines, lambda line: ~line.rlike(pattern))
