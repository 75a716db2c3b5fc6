"""Whitespace and line handling.

Java's ``\\s`` is ASCII by default and ``trim`` strips blanks only, so every helper spells the
Unicode classes out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
_RARE_BREAK = r"[\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
# Fixed value: the characters that SPACE matches under (?U).
_BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+", "")


def lines(c: Column) -> Column:
    """All lines of a text without terminators; a final terminator opens no extra line."""
    # a split by one plain character needs no pattern; most texts have no other break
    rows = F.when(c.rlike(_RARE_BREAK), F.split(c, _BREAK, -1)).otherwise(F.split(c, "\n", -1))
    return let(rows, lambda r: F.when(F.element_at(r, -1) == "", F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", " ")


def find(c: Column, pattern: str, group: int = 1) -> Column:
    """First match or NULL (``regexp_extract`` alone returns an empty string)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def present(c: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(c, F.lit(""))


def outside_fences(all_lines: Column) -> Column:
    """Text outside code fences; any fence line toggles, an unclosed fence runs to the end."""
    joined = F.array_join(all_lines, "\n")
    parts = F.split(joined, r"(?Umd)^[\s\x1c-\x1f&&[^\n]]*(?:```|~~~).*$", -1)
    return F.array_join(F.filter(parts, lambda part, i: i % 2 == 0), "\n")


def replace_each(c: Column, spelling: dict[str, str]) -> Column:
    """Apply a character table: one ``translate`` for 1:1 entries, ``replace`` for the rest."""
    single = {k: v for k, v in spelling.items() if len(v) <= 1}
    # translate() drops characters that have no counterpart, so deletions must come last
    ordered = sorted(single, key=lambda k: single[k] == "")
    c = F.translate(c, "".join(ordered), "".join(single[k] for k in ordered))
    for char, text in spelling.items():
        if len(text) > 1:
            c = F.replace(c, F.lit(char), F.lit(text))
    return c
