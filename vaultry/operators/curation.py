"""Everything a curator needs to decide about a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

# Actions offered for every page.
_BASE_ACTIONS = ["confirm", "revise", "split", "move-to-history"]


def packets(state: DataFrame, candidates: DataFrame) -> DataFrame:
    """One curation row per page: drift facts (zero when it is no candidate) and actions."""
    drift = candidates.select(
        F.col("page").alias("path"), "score", "reasons", "related_raw_count", "related_raw"
    )
    empty = F.array().cast("array<string>")
    joined = state.join(drift, "path", "left").withColumns(
        {
            "score": F.coalesce("score", F.lit(0)),
            "reasons": F.coalesce("reasons", empty),
            "related_raw_count": F.coalesce("related_raw_count", F.lit(0)),
            "related_raw": F.coalesce("related_raw", empty),
        }
    )
    extra = F.filter(
        F.array(
            F.when(
                F.col("has_superseded") | F.array_contains("reasons", "newer-related-raw"), "supersede"
            ),
            F.when(F.col("has_disputed"), "resolve-dispute"),
            F.when(F.col("block_count") == 0, "add-block-provenance"),
        ),
        lambda a: a.isNotNull(),
    )
    return joined.withColumn(
        "suggested_actions", F.concat(F.array(*map(F.lit, _BASE_ACTIONS)), extra)
    )


def packet(state: DataFrame, candidates: DataFrame, raw_notes: DataFrame, page: str) -> dict[str, DataFrame]:
    """Packet of one page; unknown pages raise ``FileNotFoundError``."""
    spark = state.sparkSession
    wanted = names.page_argument(F.lit(page), keep_anchor=True)
    row = packets(state.where(F.col("path") == wanted), candidates.where(F.col("page") == wanted))
    if row.limit(1).count() == 0:
        path = spark.range(1).select(wanted.alias("p")).first()["p"]
        raise FileNotFoundError(f"Wiki page not found: {path}")
    related = row.select(F.posexplode("related_raw").alias("position", "path")).join(raw_notes, "path")
    return {"page": row, "related_raw": related}
