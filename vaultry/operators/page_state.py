"""Per-page facts shared by drift, coverage, curation and the query packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab


def day_of(value: Column) -> Column:
    """The first ten characters as a date, NULL when they are none."""
    short = F.substring(value, 1, 10)
    # a cast reads the usual spelling faster than a pattern
    usual = short.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.when(usual, short.try_cast("date")).otherwise(F.try_to_date(short, "yyyy-M-d"))


def valid_day(value: Column) -> Column:
    """ISO text of the first ten characters when they are a date."""
    return F.date_format(day_of(value), "yyyy-MM-dd")


def latest_day(value: Column) -> Column:
    """Aggregate: the greatest :func:`valid_day`.

    Dates are compared, since Spark reduces texts by sorting all rows; years of five digits ("+12345-1-1") stand before others, as in text.
    """
    day = day_of(value)
    usual, far = F.max(F.when(F.year(day) <= 9999, day)), F.max(F.when(F.year(day) > 9999, day))
    return F.date_format(F.coalesce(usual, far), "yyyy-MM-dd")


def page_state(pages: DataFrame, blocks: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Pages plus block counters, status flags, latest check and error flag.

    Blocks and issues are aggregated by page before the join, so a page with very many blocks
    reaches the join as one row per task that read it.
    """
    def has(status: str) -> Column:
        return F.coalesce(F.bool_or(F.col("status") == status), F.lit(False)).alias(f"has_{status}")

    by_page = blocks.groupBy("path").agg(
        F.count(F.lit(1)).alias("block_count"),
        F.count_if(~F.col("has_provenance")).alias("unproven_blocks"),
        latest_day(F.col("checked")).alias("last_checked"),
        has("disputed"), has("stale"), has("superseded"),
    )
    state = pages.join(by_page, "path", "left").na.fill(0, ["block_count", "unproven_blocks"]).na.fill(
        False, ["has_disputed", "has_stale", "has_superseded"]
    )
    if issues is None:
        return state
    errors = issues.groupBy("path").agg(
        F.coalesce(
            F.bool_or(F.coalesce("severity", F.lit("error")) == "error"), F.lit(False)
        ).alias("has_error"),
        F.count(F.lit(1)).alias("issue_count"),
    )
    return state.join(errors, "path", "left").na.fill(False, ["has_error"]).na.fill(0, ["issue_count"])


def legacy_reason() -> Column:
    """Why a page cannot be answered from blocks alone; NULL when it can."""
    return (
        F.when(F.col("has_error"), "invalid-provenance")
        .when(F.col("block_count") == 0, "no-block-provenance")
        .when(F.col("unproven_blocks") > 0, "blocks-without-provenance")
    )


def coverage_status() -> Column:
    return (
        F.when(F.col("has_error"), "invalid-provenance")
        .when(F.col("migration_status") == vocab.MINIMAL_MIGRATION, "minimal-stamp")
        .when(F.col("block_count") == 0, "legacy-no-block-ids")
        .when(F.col("unproven_blocks") == 0, "covered")
        .when(F.col("unproven_blocks") < F.col("block_count"), "partial-provenance")
        .otherwise("block-ids-without-provenance")
    )
