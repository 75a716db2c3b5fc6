"""Latest log entry per file over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(entries: DataFrame) -> DataFrame:
    """Streaming aggregate keeping the entry with the greatest (date, line_no) per file.

    Unlike dropping duplicates, which keeps the first one, later entries replace earlier ones.
    Partial aggregation sends one candidate per file and task to the state store.
    """
    return entries.groupBy("file").agg(
        F.max(F.struct("date", "line_no")).alias("latest"), F.count(F.lit(1)).alias("entries")
    )


def start(entries: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the changed files of every batch to ``folder/batch=N``; read with :func:`state`."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{folder}/batch_{batch_id}"
        )

    return (
        latest(entries).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def state(updates: DataFrame) -> DataFrame:
    """Current entry per file from the saved updates."""
    return updates.groupBy("file").agg(F.max_by(F.struct("latest", "entries"), "batch").alias("u")).select(
        "file", F.col("u.latest.date").alias("date"), F.col("u.latest.line_no").alias("line_no"), "u.entries"
    )
