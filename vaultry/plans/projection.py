"""The supplied tables seen as a vault.

Every part is a page, every (part, order, line) a canonical block, every order a raw note that
links to the parts it contains.  Attributes a vault would state in prose are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.tables import table

KINDS = list(vocab.TOPICS)


def choose(values: list, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def part_path(key: Column) -> Column:
    return F.concat(F.lit("wiki/"), choose(KINDS, key % 8), F.lit("/Part "), key.cast("string"), F.lit(".md"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """path, kind, title, migration_status, part_key"""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("part_key"), part_path(key).alias("path"), choose(KINDS, key % 8).alias("kind"),
        F.when(key % 10 == 0, F.col("p_name")).otherwise(
            F.concat(F.lit("Part "), key.cast("string"))
        ).alias("title"),
        F.when(key % 17 == 0, vocab.MINIMAL_MIGRATION)
        .when(key % 13 == 0, vocab.INFERRED_MIGRATION)
        .alias("migration_status"),
    )


def block_facts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct (part, order, line) with everything a callout would state."""
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("shipped")
    )
    stated = ~((part % 5 == 0) | ((part % 5 == 1) & (line == 5)))
    offset = F.when(part % 11 == 3, (order * 3 + line) % 200 - 2).otherwise((order * 3 + line) % 200)
    status = choose(vocab.STATUSES, (order + line) % 7)

    def given(c: Column) -> Column:
        return F.when(F.col("has_provenance"), c)

    return rows.select(
        part.alias("part_key"), part_path(part).alias("path"),
        (order * 10 + line).alias("ordinal"),
        F.concat(F.lit("b"), order.cast("string"), F.lit("-"), line.cast("string")).alias("id"),
        stated.alias("has_provenance"),
        F.to_date("shipped").alias("_day"), offset.alias("_offset"),
        status.alias("_status"), (order % 3).alias("source_count"), order.alias("_order"),
    ).select(
        "part_key", "path", "ordinal", "id", "has_provenance",
        F.coalesce(given(F.col("_status")), F.lit("unknown")).alias("status"),
        F.coalesce(
            given(choose(["high", "medium", "low", None], F.col("_order") % 4)), F.lit("unknown")
        ).alias("confidence"),
        given(F.date_format("_day", "yyyy-MM-dd")).alias("observed"),
        given(
            F.when(
                F.col("_order") % 6 > 0,
                F.date_format(F.date_add("_day", F.col("_offset").cast("int")), "yyyy-MM-dd"),
            )
        ).alias("checked"),
        given(
            F.when(
                (F.col("_status") == "superseded") & (F.col("_order") % 50 > 0),
                F.concat(F.lit("b"), (F.col("_order") + 1).cast("string")),
            )
        ).alias("superseded_by"),
        given(
            F.when(F.col("part_key") % 17 == 0, vocab.MINIMAL_QUALITY)
        ).alias("provenance_quality"),
        given(F.when(F.col("_order") % 2 == 0, "historical")).alias("review_mode"),
        given(F.when(F.col("_order") % 5 == 0, "2001-01-01")).alias("evidence_latest"),
        given(F.col("source_count")).alias("source_count"),
    )


def block_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Validation issues of the projected blocks."""
    from ..operators import provenance

    metadata = block_facts(spark, sf).where("has_provenance").select(
        "path", F.col("id").alias("block_id"), "status",
        F.when(F.col("confidence") != "unknown", F.col("confidence")).alias("confidence"),
        "observed", "checked", "superseded_by",
        F.lit(True).alias("in_text"), F.lit(True).alias("sources_given"),
        F.array_repeat(F.lit("raw/x.md"), F.col("source_count").cast("int")).alias("sources"),
        (F.col("part_key") % 17 == 0).alias("minimal_stamp"),
    )
    return provenance.metadata_issues(metadata)


def raw_notes(spark: SparkSession, sf: str) -> DataFrame:
    """path, title, date, source_type, order_key; every fourth note is named after a page."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        key.alias("order_key"),
        F.concat(F.lit("raw/notes/"), day, F.lit(" Order "), key.cast("string"), F.lit(".md")).alias("path"),
        F.when(key % 4 == 0, F.concat(F.lit("part  "), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit("Order "), key.cast("string"))).alias("title"),
        F.when(key % 9 > 0, day).alias("date"), F.col("o_orderpriority").alias("source_type"),
    )


def note_links(spark: SparkSession, sf: str) -> DataFrame:
    """(order_key, target): links of a raw note to the parts of its order."""
    # keys are told apart as numbers; their text is written once for each
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().select(
        F.col("l_orderkey").alias("order_key"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("target"),
    )


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """(title_key, note, date) from links and from note titles."""
    from ..functions import names

    notes = raw_notes(spark, sf)
    linked = note_links(spark, sf).join(notes, "order_key").select(
        names.plain_title(F.col("target")).alias("title_key"), F.col("path").alias("note"), "date"
    )
    titled = notes.select(
        names.plain_title(F.col("title")).alias("title_key"), F.col("path").alias("note"), "date"
    )
    return linked.unionByName(titled)
