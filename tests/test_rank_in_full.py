"""Ranking every block: the sort carries what the result needs and no more."""

from pyspark.sql import functions as F

from vaultry.operators import freshness


def blocks(spark):
    key = F.col("id")
    return spark.range(60).select(
        F.format_string("wiki/%d/p.md", key % 3).alias("path"), key.alias("ordinal"), F.format_string("b%d", key % 20).alias("id"),
        F.element_at(F.array(*map(F.lit, ["current", "stale", "disputed", ""])), (key % 4 + 1).cast("int")).alias("status"),
        F.when(key % 5 > 0, "high").alias("confidence"), F.when(key % 7 > 0, F.format_string("2024-0%d-01", key % 9 + 1)).alias("checked"),
        F.lit("2024-01-01").alias("observed"), F.when(key % 6 == 0, "minimal-risk-stamp").alias("provenance_quality"),
        F.lit("x").alias("superseded_by"), F.lit(None).cast("string").alias("evidence_latest"), F.lit("m").alias("review_mode"),
        F.when(key % 2 == 0, "What changed?").otherwise("What is it?").alias("question"),
    )


def test_full_ranks_are_those_of_the_limited_ranking(spark):
    for question in ("Which was the original?", F.col("question")):
        full, top = freshness.rank(blocks(spark), question, None), freshness.rank(blocks(spark), question, 60)
        assert full.columns == top.columns
        assert [r.asDict() for r in full.orderBy("rank").collect()] == [r.asDict() for r in top.orderBy("rank").collect()]


def test_the_sort_of_all_blocks_carries_no_notes(spark):
    columns = ["rank", "id", "freshness_action", "query_intent"]

    def written(ranked):
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        return [line for line in plan.splitlines() if "LogicalRDD" in line][0]

    full = freshness.rank(blocks(spark), "now", None)
    assert "observed" in written(full) and not any(c in written(full) for c in ("freshness_note", "_page_order", "_month"))
    few = freshness.rank(blocks(spark), "now", None, columns)
    assert few.columns == columns and "status" in written(few) and not any(c in written(few) for c in ("observed", "checked", "path"))
    assert few.orderBy("rank").collect() == full.select(*columns).orderBy("rank").collect()
