"""Mail exports: delimited HTML headers, MIME messages, companion notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text

# The delimited header of an HTML mail export; "," or ";" between fields.
_HEADER = (
    r"(?s)\AFROM:([^,;]*)[,;]TO:(.*?)(?:[,;]CC:(.*?))?(?:[,;]BCC:(.*?))?"
    r"[,;]SUBJECT:(.*?)[,;]BODY:(.*)\z"
)
_STAMPED_NAME = r"\A(\d{4}-\d{2}-\d{2})T(\d{2})_(\d{2})_(\d{2})([+-]\d{2})_(\d{2})"
NO_SENDER, NO_RECIPIENT, NO_SUBJECT = "(unknown sender)", "(unknown recipient)", "(no subject)"


def html_text(c: Column) -> Column:
    """Tags dropped, at most one blank line in a row."""
    return text.strip(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\n{3,}", "\n\n"))


def addresses(c: Column) -> Column:
    """Address list with ", " between entries; split at commas, else at semicolons."""
    pieces = F.when(c.contains(","), F.split(c, ",")).otherwise(F.split(c, ";"))
    return F.array_join(F.filter(F.transform(pieces, text.strip), lambda a: a != ""), ", ")


def parse_exports(files: DataFrame) -> DataFrame:
    """Mail rows from HTML exports (path, content); without a header the file is all body."""
    rows = files.withColumn("_text", text.strip(F.col("content"))).withColumn(
        "structured", F.col("_text").rlike(_HEADER)
    )

    def part(group: int) -> Column:
        return text.strip(F.regexp_extract("_text", _HEADER, group))

    def known(c: Column, default: str) -> Column:
        return F.coalesce(text.present(c), F.lit(default))

    return rows.select(
        "path", "structured", known(part(1), NO_SENDER).alias("from"),
        known(addresses(part(2)), NO_RECIPIENT).alias("to"), addresses(part(3)).alias("cc"),
        addresses(part(4)).alias("bcc"), known(part(5), NO_SUBJECT).alias("subject"),
        html_text(F.when(F.col("structured"), part(6)).otherwise(F.col("content"))).alias("body"),
    )


def export_date(path: Column, mtime: Column) -> Column:
    """UTC-independent date of an export: the one in its name, else the file time."""
    stem = paths.stem(path)
    named = F.when(
        stem.rlike(_STAMPED_NAME) & F.try_to_date(F.substring(stem, 1, 10), "yyyy-MM-dd").isNotNull(),
        F.regexp_extract(stem, _STAMPED_NAME, 1),
    )
    return F.coalesce(named, F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd"))


_MESSAGE = (
    "date string, date_source string, `from` string, `to` string, cc string, bcc string, "
    "subject string, body string, html boolean"
)


def _message(raw: bytes) -> tuple:
    """Fields of one MIME message, read with the standard library."""
    import email
    import email.header
    import email.utils

    msg = email.message_from_bytes(raw)

    def header(*names: str) -> str:
        value = next((msg.get(n) for n in names if msg.get(n)), "")
        chunks = email.header.decode_header(value) if value else []
        joined = "".join(
            c.decode(charset or "utf-8", "replace") if isinstance(c, bytes) else c for c, charset in chunks
        )
        return " ".join(joined.split())

    def when(value: str):
        try:
            return email.utils.parsedate_to_datetime(value.strip()).strftime("%Y-%m-%d")
        except (TypeError, ValueError):
            return None

    day, origin = when(msg.get("Date") or ""), "Date header"
    for received in msg.get_all("Received") or []:
        if day is None and ";" in received:
            day, origin = when(received.rsplit(";", 1)[1]), "Received header"
    found: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in msg.walk():
        payload = part.get_payload(decode=True)
        kind = part.get_content_type()
        if part.get_content_disposition() == "attachment" or not payload or kind not in found:
            continue
        try:
            found[kind].append(payload.decode(part.get_content_charset() or "utf-8", "replace"))
        except LookupError:
            found[kind].append(payload.decode("utf-8", "replace"))
    plain = bool(found["text/plain"])
    body = "\n\n".join(found["text/plain" if plain else "text/html"])
    return (
        day, origin if day else None, header("From"), header("To"), header("CC", "Cc"),
        header("BCC", "Bcc"), header("Subject"), body, not plain and bool(body),
    )


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0].strip("`") for c in _MESSAGE.split(", ")]
    for batch in batches:
        fields = pd.DataFrame([_message(bytes(b)) for b in batch["content"]], columns=names, index=batch.index)
        yield pd.concat([batch[["path", "mtime"]], fields], axis=1)


def parse_messages(files: DataFrame) -> DataFrame:
    """Mail rows from MIME files (path, content BINARY, mtime).

    Only MIME decoding runs in Python; defaults and HTML stripping stay in Spark.
    """
    rows = files.select("path", F.col("mtime").cast("bigint").alias("mtime"), "content").mapInPandas(
        _messages, f"path string, mtime bigint, {_MESSAGE}"
    )

    def known(name: str, default: str) -> Column:
        return F.coalesce(text.present(F.col(name)), F.lit(default)).alias(name)

    return rows.select(
        "path",
        F.coalesce("date", F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd")).alias("date"),
        F.coalesce("date_source", F.lit("file time")).alias("date_source"),
        known("from", NO_SENDER), known("to", NO_RECIPIENT), "cc", "bcc", known("subject", NO_SUBJECT),
        F.when(F.col("html"), html_text(F.col("body"))).otherwise(text.strip(F.col("body"))).alias("body"),
        F.when(F.col("html"), "text/html").when(F.col("body") != "", "text/plain").otherwise("empty")
        .alias("body_source"),
    )


# companion notes -------------------------------------------------------------------------------
def yaml_string(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def text_callout(c: Column) -> Column:
    """Collapsed callout holding a text, every line quoted."""
    quoted = F.transform(text.lines(c), lambda l: text.rstrip(F.concat(F.lit("> "), l)))
    body = F.when(c == "", F.array(F.lit(">"))).otherwise(quoted)
    return F.concat(F.lit("> [!ocr-extractor]- Extracted text\n"), F.array_join(body, "\n"))


def mail_note(name: Column) -> Column:
    """Companion note of a mail row (date, from, to, cc, bcc, subject, body)."""
    def line(label: str, key: str, quoted: bool) -> Column:
        value = yaml_string(F.col(key)) if quoted else F.col(key)
        out = F.concat(F.lit(f"{label}: "), value, F.lit("\n"))
        return F.when(F.col(key) != "", out).otherwise("") if key in ("cc", "bcc") else out

    return F.concat(
        F.lit("---\ntype: email\n"), line("subject", "subject", True), line("date", "date", False),
        F.lit("source: "), yaml_string(F.concat(F.lit("_resources/"), name)), F.lit("\n"),
        line("from", "from", True), line("to", "to", True), line("cc", "cc", True), line("bcc", "bcc", True),
        F.lit("---\n\n![["), name, F.lit("]]\n\n```\n"),
        line("Date", "date", False), line("From", "from", False), line("To", "to", False),
        line("CC", "cc", False), line("BCC", "bcc", False), line("Subject", "subject", False),
        F.lit("```\n\n"), text_callout(F.col("body")), F.lit("\n"),
    )


def generic_note(name: Column, body: Column, now: str) -> Column:
    """Companion note of any other file."""
    return F.concat(
        F.lit('---\nsource: "_resources/'), name, F.lit(f'"\nconverted: {now}\n---\n\n![['), name,
        F.lit("]]\n\n"), text_callout(body), F.lit("\n"),
    )
