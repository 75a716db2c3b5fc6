"""How far block provenance covers the pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from .page_state import coverage_status


def _priority(status: Column, kind: Column) -> Column:
    out = None
    for value, points in vocab.COVERAGE_PRIORITY.items():
        out = F.when(status == value, points) if out is None else out.when(status == value, points)
    for value, points in vocab.KIND_PRIORITY.items():
        out = out.when(kind == value, points)
    return out.otherwise(vocab.OTHER_KIND_PRIORITY)


def with_status(state: DataFrame) -> DataFrame:
    return state.withColumn("coverage_status", coverage_status())


def backlog(state: DataFrame) -> DataFrame:
    """Pages that are not covered, most urgent first by ``ordered``."""
    return with_status(state).where("coverage_status <> 'covered'").select(
        "path", "title", "kind", "coverage_status", "block_count",
        _priority(F.col("coverage_status"), F.col("kind")).alias("priority"), "issue_count",
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("priority"), "kind", "path")


def counts(state: DataFrame) -> DataFrame:
    """Pages by status and, independently, by kind, from one pass: (facet, value, pages)."""
    grouped = with_status(state).groupingSets(
        [[F.col("coverage_status")], [F.col("kind")]], F.col("coverage_status"), F.col("kind")
    ).agg(F.count(F.lit(1)).alias("pages"), F.grouping("kind").alias("_by_status"))
    by_status = F.col("_by_status") == 1
    return grouped.select(
        F.when(by_status, "status").otherwise("kind").alias("facet"),
        F.when(by_status, F.col("coverage_status")).otherwise(F.col("kind")).alias("value"),
        "pages",
    )


def summary(state: DataFrame) -> DataFrame:
    return with_status(state).agg(
        F.count(F.lit(1)).alias("wiki_pages"),
        F.count_if(F.col("coverage_status") == "covered").alias("covered_pages"),
        F.count_if(F.col("coverage_status") != "covered").alias("backlog_pages"),
    )
