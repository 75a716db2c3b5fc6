"""Dates found in names, fields and prose, each with the confidence it deserves.

A dated value is a struct ``(date STRING, confidence STRING)``; NULL means no date.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths, text, vocab

# Date patterns. Digit look-arounds accept "_" next to a date, \b does not.
ISO_WORD = r"(?U)\b((?:19|20)\d{2})-(0[1-9]|1[0-2])-([0-3]\d)\b"
ISO_NAME = r"(?<!\d)((?:19|20)\d{2})-(0[1-9]|1[0-2])-([0-3]\d)(?!\d)"
DAY_FIRST = r"(?<!\d)([0-3]\d)-(0[1-9]|1[0-2])-((?:19|20)\d{2})(?!\d)"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
YEAR_RANGE = r"(?U)(?<!\d)((?:19|20)\d{2})[\s\x1c-\x1f]*[-–][\s\x1c-\x1f]*((?:19|20)\d{2})(?!\d)"
MONTH_YEAR = r"(?iU)\b(" + "|".join(vocab.MONTHS) + r")[a-z]*\.?[\s\x1c-\x1f]+((?:19|20)\d{2})\b"
SPAN_DASH = "–"


def month_number(c: Column) -> Column:
    """Two-digit month of an English month name; compared on its first three letters."""
    at = F.array_position(F.array(*map(F.lit, vocab.MONTHS)), F.lower(F.substring(c, 1, 3)))
    return F.lpad(at.cast("string"), 2, "0")


def _grain(date: Column, grain: str) -> Column:
    return text.let(
        date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(grain).alias("grain")))
    )


def normal(c: Column) -> Column:
    """First date in a text as ``(date, grain)``: full date, month (day 01), year (07-01)."""
    return text.let(text.strip(c), _normal)


def _normal(c: Column) -> Column:
    iso = text.find(c, ISO_WORD, 0)
    month = F.when(
        c.rlike(MONTH_YEAR),
        F.concat(
            F.regexp_extract(c, MONTH_YEAR, 2), F.lit("-"),
            month_number(F.regexp_extract(c, MONTH_YEAR, 1)), F.lit("-01"),
        ),
    )
    year = F.concat(text.find(c, YEAR, 1), F.lit("-07-01"))
    return F.coalesce(_grain(iso, "day"), _grain(month, "month"), _grain(year, "year"))


def _dated(date: Column, confidence: str | Column) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return text.let(
        date,
        lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), confidence.alias("confidence"))),
    )


def from_file_name(path: Column) -> Column:
    """``(date, span, confidence)`` coded in a file name: year range, ISO, day-first, other."""
    return text.let(paths.name(path), _from_base_name)


def _from_base_name(base: Column) -> Column:
    first = F.regexp_extract(base, YEAR_RANGE, 1)
    second = F.regexp_extract(base, YEAR_RANGE, 2)
    early, late = F.least(first, second), F.greatest(first, second)
    span = F.when(early == late, early).otherwise(F.concat(early, F.lit(SPAN_DASH), late))
    day_first = F.when(
        base.rlike(DAY_FIRST),
        F.concat_ws(
            "-",
            F.regexp_extract(base, DAY_FIRST, 3), F.regexp_extract(base, DAY_FIRST, 2),
            F.regexp_extract(base, DAY_FIRST, 1),
        ),
    )
    single = F.coalesce(text.find(base, ISO_NAME, 0), day_first, normal(base)["date"])

    def high(date: Column, covered: Column) -> Column:
        return F.struct(
            date.alias("date"), covered.alias("span"), F.lit("high").alias("confidence")
        )

    whole = text.let(
        single, lambda date: F.when(date.isNotNull(), high(date, F.substring(date, 1, 4)))
    )
    return F.when(base.rlike(YEAR_RANGE), high(F.concat(late, F.lit("-07-01")), span)).otherwise(whole)


def from_fields(field, skip_date: bool = False) -> Column:
    """Best date among front-matter fields; ``field(key)`` yields the value of a key.

    A value this engine wrote earlier (it carries ``date_confidence``) keeps its confidence.
    """
    found = []
    if not skip_date:
        own = normal(field("date"))["date"]
        stated = field("date_confidence")
        trusted = F.when(stated.isin(list(vocab.DATE_CONFIDENCE_RANK)), stated).otherwise("low")
        found.append(F.when(stated.isNotNull(), _dated(own, trusted)))
    tiers = [
        ("high", [k for k in vocab.CONTENT_DATE_FIELDS if not (skip_date and k == "date")]),
        ("medium", vocab.EDIT_DATE_FIELDS),
        ("low", vocab.CAPTURE_DATE_FIELDS),
    ]
    for confidence, keys in tiers:
        found += [_dated(normal(field(key))["date"], confidence) for key in keys]
    return F.coalesce(*found)


def from_prose(body: Column) -> Column:
    """Latest plausible full or month date in running text."""
    iso = F.regexp_extract_all(body, F.lit(ISO_WORD), F.lit(0))
    months = F.zip_with(
        F.regexp_extract_all(body, F.lit(MONTH_YEAR), F.lit(2)),
        F.regexp_extract_all(body, F.lit(MONTH_YEAR), F.lit(1)),
        lambda year, month: F.concat(year, F.lit("-"), month_number(month), F.lit("-01")),
    )
    plausible = F.filter(F.concat(iso, months), lambda d: d.between("1990", "2035-12-31"))
    return _dated(F.array_max(plausible), "low")


def dated(date: Column, confidence: str | Column) -> Column:
    return _dated(date, confidence)


def ingest_order_key(path: Column, mtime: Column) -> Column:
    """Sort key of an ingest candidate: the date leading the deepest dated path component.

    Missing months and days count as the last ones; without a dated component the modification
    time decides.
    """
    dated_part = r"(?U)\A(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?(?=[\s\x1c-\x1f_\-.]|\z)"
    hits = F.filter(F.split(path, "/"), lambda p: p.rlike(dated_part))

    def coded(last: Column) -> Column:
        def piece(group: int) -> Column:
            return text.present(F.regexp_extract(last, dated_part, group))

        month, day = F.coalesce(piece(2), F.lit("12")), F.coalesce(piece(3), F.lit("31"))
        return F.concat(piece(1), F.lit("-"), month, F.lit("-"), day, F.lit("T23:59:59"))

    clock = F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(text.let(F.try_element_at(hits, F.lit(-1)), coded), clock)


def from_argument(c: Column) -> Column:
    """A day given as year-month-day, day-month-year or year/month/day; NULL for anything else."""
    def day(pattern: str, year: int, month: int, date: int) -> Column:
        parts = [F.regexp_extract(c, pattern, i) for i in (year, month, date)]
        return F.when(c.rlike(pattern), F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d"))

    return F.coalesce(
        day(r"\A([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\z", 1, 2, 3), day(r"\A([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})\z", 3, 2, 1),
        day(r"\A([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})\z", 1, 2, 3),
    )
