"""Continuous ingestion: Spark's state store holds what was processed, the log is the sink.

A file source remembers paths and times only; a renamed or touched file looks new to it.  Two states decide, one of the paths with their
times, one of the content hashes.  Both are kept in the state store by key, so a micro-batch costs what its own files cost, however
long the history is, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ingest

LOG_COLUMNS = "file string, hash string, mtime bigint"
_ROWS = "path string, mtime bigint, hash string"


def _unseen_hash(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All rows of a hash in the first micro-batch that has it, none later."""
    if state.exists:
        return
    state.update((True,))
    yield from batches


def unprocessed(
    files: DataFrame, protected: DataFrame | None = None, earlier_log: DataFrame | None = None
) -> DataFrame:
    """Streaming (path, mtime, content) to the files that are new by content: path, mtime, hash.

    A file is skipped when its path and time were seen before, or when its hash was; copies that come in one micro-batch are all
    taken, as in a batch run.  A path with a NULL time is told by its hash alone.  ``earlier_log`` (file, hash, mtime) is a log
    from before the stream, with whatever entries of the older layout there are; ``protected`` has the paths to leave out.  Both are
    static and read in every micro-batch.
    """
    spark = files.sparkSession
    nobody = spark.createDataFrame([], "path string")
    log = spark.createDataFrame([], LOG_COLUMNS) if earlier_log is None else earlier_log.select("file", "hash", "mtime")
    fresh = ingest.new_files(files, log, nobody if protected is None else protected, nobody)
    # without a time, the hash tells whether a path was seen
    timed = fresh.withColumn("_other", F.when(F.col("mtime").isNull(), F.col("hash"))).dropDuplicates(["path", "mtime", "_other"])
    return timed.select("path", "mtime", "hash").groupBy("hash").applyInPandasWithState(
        _unseen_hash, _ROWS, "seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def start(
    files: DataFrame, log_folder: str, checkpoint: str, protected: DataFrame | None = None,
    earlier_log: DataFrame | None = None, max_rows_per_file: int = 1_000_000,
) -> StreamingQuery:
    """Append every new file to the log (Parquet: file, hash, mtime); stops when the input is drained.

    The sink keeps a list of the files that belong to finished micro-batches, so one that is repeated after a failure counts once.
    """
    rows = unprocessed(files, protected, earlier_log).withColumnRenamed("path", "file")
    return (
        rows.select("file", "hash", "mtime").writeStream.format("parquet").outputMode("append")
        .option("path", log_folder).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", max_rows_per_file)
        .trigger(availableNow=True).start()
    )
