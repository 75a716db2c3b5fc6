"""Reports as ordered lines.

A report is a DataFrame of lines with a sort key.  It is written as sorted part files that read in
order when concatenated; no task holds a whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def _rows(df: DataFrame, section: int, order: list[Column], *lines: Column) -> DataFrame:
    """Lines of every row: (section, key, at, line); ``key`` sorts the rows."""
    return df.select(
        F.lit(section).alias("section"), F.struct(*order).alias("key"),
        F.posexplode(F.array(*lines)).alias("at", "line"),
    )


def write(report: DataFrame, folder: str) -> None:
    report.orderBy("section", "key", "at").select("line").write.mode("overwrite").text(folder)


def drift_queue(candidates: DataFrame) -> DataFrame:
    """Checklist of curation candidates, most urgent first."""
    page = paths.drop_md(F.col("page"))
    first = F.concat(
        F.lit("- [ ] **[["), page, F.lit("]]** score "), F.col("score").cast("string"), F.lit(" — "),
        F.array_join("reasons", ", "),
    )
    unknown = lambda c: F.coalesce(F.col(c), F.lit("?"))
    second = F.concat(
        F.lit("      <sub>latest related raw: "), unknown("latest_related_raw_date"), F.lit("; checked: "),
        unknown("checked"), F.lit("; related raw notes: "), F.col("related_raw_count").cast("string"), F.lit("</sub>"),
    )
    return _rows(candidates, 1, [(-F.col("score")).alias("a"), F.col("page").alias("b")], first, second)


def status_counts(state: DataFrame) -> DataFrame:
    """Head of the coverage backlog: a line for each coverage status of all pages."""
    counts = state.groupBy("coverage_status").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- "), "coverage_status", F.lit(": "), F.col("n").cast("string"))
    return _rows(counts, 0, [F.lit(0).alias("a"), F.col("coverage_status").alias("b"), F.lit("").alias("c")], line)


def coverage_backlog(rows: DataFrame) -> DataFrame:
    """Checklist of pages without full provenance."""
    first = F.concat(
        F.lit("- [ ] **[["), paths.drop_md(F.col("path")), F.lit("]]** `"), "coverage_status", F.lit("` priority "),
        F.col("priority").cast("string"),
    )
    second = F.concat(
        F.lit("      <sub>kind: "), "kind", F.lit("; blocks: "), F.col("block_count").cast("string"), F.lit("</sub>")
    )
    order = [(-F.col("priority")).alias("a"), F.col("kind").alias("b"), F.col("path").alias("c")]
    return _rows(rows, 1, order, first, second)


def supersession_queue(candidates: DataFrame, order: list[Column]) -> DataFrame:
    """Review queue: section 1 with a guessed successor, section 2 without."""
    guess = F.col("guess")
    tail = F.when(guess != "", F.concat(F.lit("guessed successor: `"), guess, F.lit("`"))).otherwise("successor: _?_")
    first = F.concat(
        F.lit("- [ ] **[["), paths.drop_md(F.col("path")), F.lit("]]** _( "), "topic", F.lit(" )_ — _"), "phrase",
        F.lit("_ → "), tail,
    )
    second = F.concat(F.lit("      <sub>"), "context", F.lit("</sub>"))
    named = [c.alias(f"k{i}") for i, c in enumerate(order)]
    return _rows(candidates, 1, named, first, second).withColumn(
        "section", F.when(F.col("key.k0"), 2).otherwise(1)
    )
