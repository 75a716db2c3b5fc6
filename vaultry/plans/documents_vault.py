"""Documents as raw files with a log, and events as a damaged, repetitive ingest log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import content_hash
from ..sources import ledger as log_source
from ..sources.tables import table


def doc_name() -> Column:
    key, text_key = F.col("doc_id"), F.col("doc_id").cast("string")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int"))
    lead = (
        F.when(key % 3 == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" ")))
        .when(key % 3 == 1, F.concat(F.date_format(day, "yyyy-MM"), F.lit("_")))
        .otherwise("")
    )
    ext = (
        F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".txt")
        .when(F.col("lang") == "de", ".eml").otherwise(".html")
    )
    return F.concat(lead, F.lit("doc "), text_key, ext)


def doc_path() -> Column:
    return F.concat(F.lit("raw/"), F.col("source"), F.lit("/"), doc_name())


def files(spark: SparkSession, sf: str) -> DataFrame:
    """path, name, mtime, content, plus the document columns."""
    return table(spark, sf, "documents").select(
        "*", doc_path().alias("path"), doc_name().alias("name"),
        (F.lit(1_577_836_800) + F.col("doc_id") * 3600).alias("mtime"), F.col("text").alias("content"),
    )


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """English documents as notes; short ones refuse ingestion and point at other files."""
    docs = files(spark, sf).where("lang = 'en'")
    names = table(spark, sf, "documents").select(
        (F.col("doc_id") - 1).alias("doc_id"), doc_name().alias("_next"), F.col("source").alias("_folder")
    )
    linked = docs.join(names, "doc_id", "left").withColumn("_next", F.coalesce("_next", F.lit("none.md")))
    head = F.concat(
        F.lit("---\ntitle: x\n"),
        F.when(F.col("n_chars") < 800, F.lit("ingest: 'false' # keep\n")).otherwise("ingest: true\n"),
        F.lit("source: "), F.coalesce("_folder", F.lit("none")), F.lit("/x.pdf\n---\n# Note\n\n"),
    )
    links = F.concat(
        F.lit("See [[raw/"), F.coalesce("_folder", F.lit("none")), F.lit("/"), F.col("_next"),
        F.lit("|next]] and ![["), F.col("_next"),
        F.lit("]] or [here](<"), F.replace(F.col("name"), F.lit(" "), F.lit("%20")), F.lit(">).\n\n"),
    )
    return linked.select("path", F.concat(head, links, F.col("content")).alias("content"))


def document_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log of the labelled documents: stamped, modified since, or path only."""
    docs = files(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    stamped, modified = F.col("quality") == 1, F.col("toxic") == 1
    hashed = (
        F.when(modified, content_hash(F.concat("content", F.lit("!"))))
        .when(stamped, content_hash(F.col("content")))
    )
    folder, name = F.concat(F.lit("raw/"), F.col("source")), F.col("name")
    converted = (F.col("source") == "src7") & stamped
    return docs.select(
        F.col("doc_id").alias("line_no"),
        F.when(converted, F.concat(folder, F.lit("/converted/"), name, F.lit(".md")))
        .otherwise(F.col("path")).alias("file"),
        hashed.alias("hash"),
        F.when(modified, F.col("mtime") - 5).when(stamped, F.col("mtime")).alias("mtime"),
    )


def companion_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Companion notes of the documents of two sources; one set names another file."""
    docs = files(spark, sf).where("source IN ('src5', 'src6') AND lang <> 'en'")
    stem = F.regexp_replace("path", r"\.[^.]+\z", "")
    named = F.when(F.col("source") == "src5", F.col("name")).otherwise("another.eml")
    return docs.select(
        F.concat(stem, F.lit(".md")).alias("path"),
        F.concat(F.lit('---\ntype: note\nsource: "_resources/'), named, F.lit('"\n---\n'), F.col("content"))
        .alias("content"),
    )


def event_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line_no, value): one JSON line per event; some lines are cut off, some blank."""
    k = F.get_json_object("props", "$.k").cast("int")
    page = lambda n: F.concat(F.lit("wiki/p"), n.cast("string"), F.lit(".md"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    created = F.when(
        F.col("event_type").isin("purchase", "signup"),
        F.concat(
            F.lit(', "pages_created": ['), quoted(page(k)), F.lit(", "), quoted(page(k % 7)), F.lit("]")
        ),
    ).when(F.col("event_type") == "view", F.lit(', "pages_created": null')).otherwise("")
    line = F.concat(
        F.lit('{"date": "'), F.date_format("ts", "yyyy-MM-dd HH"), F.lit('", "session": '),
        F.col("event_id").cast("string"), F.lit(', "file": "raw/users/u'), F.col("user_id").cast("string"),
        F.lit('.md", "note": {"type": "'), F.col("event_type"), F.lit('"}'), created, F.lit("}"),
    )
    damaged = (
        F.when(F.col("event_id") % 97 == 5, F.substring(line, F.lit(1), F.length(line) - 9))
        .when(F.col("event_id") % 101 == 7, "   ")
        .otherwise(line)
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), damaged.alias("value"))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return log_source.parse_lines(event_log_lines(spark, sf))


def user_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files that still exist: those of customers outside one market segment."""
    return table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("raw/users/u"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path")
    )
