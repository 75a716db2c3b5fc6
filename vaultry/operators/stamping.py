"""Minimal provenance stamps for reviewed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter, paths, text, vocab
from . import provenance

_SPEC = (
    "page string, stamp_mode string, mode string, reason string, sources array<string>, "
    "related_raw array<string>, latest_related_raw_date string"
)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Stamp requests from a JSON manifest: a list, or an object with ``auto_ok``."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.when(
        text.lstrip(F.col("value")).startswith("["), F.from_json("value", f"array<struct<{_ddl()}>>")
    ).otherwise(F.from_json("value", f"auto_ok array<struct<{_ddl()}>>")["auto_ok"])
    return specs(whole.select(F.explode(listed).alias("s")).select("s.*"))


def _ddl() -> str:
    return ", ".join(f.replace(" ", ": ", 1) for f in _SPEC.split(", "))


def specs(rows: DataFrame) -> DataFrame:
    """Requests with defaults: page, mode, reason, sources, latest_related_raw_date."""
    mode = F.coalesce(text.present(F.col("stamp_mode")), text.present(F.col("mode")))
    none = F.array().cast("array<string>")
    return rows.where(F.coalesce("page", F.lit("")) != "").select(
        "page", F.when(mode.isin(list(vocab.STAMP_TEXT)), mode).otherwise("historical").alias("mode"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce(F.when(F.size("sources") > 0, F.col("sources")), "related_raw", none).alias("sources"),
        "latest_related_raw_date",
    )


def free_block_id(content: Column, base: str = "freshness-status") -> Column:
    """``base``, or the first of base-2, base-3, ... the page does not use."""
    ids = F.regexp_extract_all(
        text.outside_fences(text.lines(content)), F.lit(provenance.BLOCK_ID), F.lit(1)
    )

    def pick(used: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(2), F.size(used) + 2), lambda n: F.concat(F.lit(f"{base}-"), n.cast("string"))
        )
        return F.when(~F.array_contains(used, base), base).otherwise(
            F.get(F.array_except(numbered, used), F.lit(0))
        )

    return text.let(ids, pick)


def stamped(content: Column, block_id: Column, checked: str) -> Column:
    """Page text with the status section after its title and the callout at its end."""
    words = None
    for mode, sentence in vocab.STAMP_TEXT.items():
        words = F.when(F.col("mode") == mode, sentence) if words is None else words.when(F.col("mode") == mode, sentence)
    section = F.concat(F.lit("\n## Freshness Status\n\n"), words, F.lit(" ^"), block_id, F.lit("\n"))

    def place(rows: Column) -> Column:
        # each number is bound once: inside the lambda over lines it would be looked for again for every line
        def at_title(start: Column) -> Column:
            title = F.array_position(
                F.transform(rows, lambda l, i: (i >= start) & l.rlike(r"(?U)\A#\s+\S")), F.lit(True)
            ).cast("int")
            return F.when(title > 0, title).otherwise(start)

        def joined(at: Column) -> Column:
            return F.concat(
                F.array_join(F.slice(rows, F.lit(1), at), "\n"), F.when(at > 0, "\n").otherwise(""), section,
                F.lit("\n"), F.array_join(F.slice(rows, at + 1, F.size(rows)), "\n"),
            )

        return text.let(text.let(frontmatter.closing_line_number(rows), at_title), joined)

    body = text.rstrip(text.let(text.lines(content), place))
    sources = F.when(F.size("sources") == 0, "[]").otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("sources", lambda s: F.concat(
            F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')
        )), ", "), F.lit("]"))
    )
    callout = F.concat(
        F.lit("\n\n> [!provenance]- Provenance\n> schema: kb-prov-v1\n> migration_status: "
              f"{vocab.MINIMAL_MIGRATION}\n> blocks:\n>   "), block_id,
        F.lit(":\n>     sources: "), sources,
        F.lit(f"\n>     checked: {checked}\n>     status: current\n>     confidence: medium\n"
              f">     provenance_quality: {vocab.MINIMAL_QUALITY}\n>     scope: page-level caution only; "
              "detailed claims not yet block-mapped\n>     review_mode: "), F.col("mode"),
        F.when(F.coalesce("latest_related_raw_date", F.lit("")) != "",
               F.concat(F.lit("\n>     evidence_latest: "), "latest_related_raw_date")).otherwise(""),
        F.when(F.col("reason") != "", F.concat(F.lit("\n>     review_note: "), "reason")).otherwise(""),
        F.lit("\n"),
    )
    return F.concat(body, callout)


def stamp(requests: DataFrame, pages: DataFrame, checked: str) -> DataFrame:
    """Outcome per request: page, action, reason, block_id, content (the stamped text).

    Paths outside wiki/ are refused, missing pages reported, pages with a callout skipped.
    """
    keyed = requests.withColumn("_path", paths.resolved(F.col("page")))
    parsed = provenance.callouts(pages).select(
        F.col("path").alias("_path"), "content", F.col("callout").isNotNull().alias("_has")
    )
    rows = keyed.join(parsed, "_path", "left").withColumn("block_id", free_block_id(F.col("content")))
    invalid = ~F.coalesce(F.col("_path").startswith("wiki/"), F.lit(False))
    action = (
        F.when(invalid, "skipped").when(F.col("content").isNull(), "missing").when(F.col("_has"), "skipped")
        .otherwise("stamped")
    )
    reason = F.when(invalid, "invalid-path").when(F.col("_has"), "page already has provenance")
    done = F.col("action") == "stamped"
    return rows.withColumns({"action": action, "_why": reason}).select(
        "page", "action", F.col("_why").alias("outcome_reason"), F.when(done, F.col("mode")).alias("mode"),
        F.when(done, F.col("block_id")).alias("block_id"),
        F.when(done, stamped(F.col("content"), F.col("block_id"), checked)).alias("content"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("action").agg(F.count(F.lit(1)).alias("pages"))
