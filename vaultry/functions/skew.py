"""Numbering and windows that survive a key holding a large share of the rows.

Equi-joins need no helper: adaptive execution splits large partitions of either side, at every size by the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def shuffled(side: DataFrame) -> DataFrame:
    """``side`` of an equi-join that is sorted and merged, never sent to the driver.

    A size estimated from files knows nothing of exploded rows and of text built from columns: a table that seems to be a few MB can be
    GB. Sides whose rows grow with the vault are marked; those that stay small by what they are (terms of a question, types) need not be.
    """
    return side.hint("merge")


def numbered(
    df: DataFrame, order: Sequence[Column], column: str = "row_number", partitions: int | None = None,
    kept: Sequence[str] = ("*",),
) -> DataFrame:
    """1-based position in a total order, computed without gathering the rows in one task.

    Rows are range-partitioned and sorted; a checkpoint fixes that layout, so the per-partition
    counts and the numbering see the same rows even when executors are lost.  ``order`` must end
    in a unique key, which also lets a run of equal leading values be split over partitions.
    Columns that only the order needs are written nowhere when ``kept`` leaves them out.
    """
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    laid_out = checkpointed(
        ranged.sortWithinPartitions(*order).select(
            *kept,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_offset"),
        )
    )
    # one row per partition
    sizes = laid_out.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return (
        laid_out.join(F.broadcast(starts), "_part")
        .withColumn(column, F.col("_start") + F.col("_offset") + 1)
        .drop("_part", "_offset", "_start")
    )


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key.

    A rank filter lets Spark keep ``k`` rows per key and task before the shuffle, so one key with
    many rows does not travel to one task as a whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which a NULL key or position meets its like, so no row is lost."""
    other = carried.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], "_carried")
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_r{i}"))
    return rows.join(other, same, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def with_previous(
    df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], bucket: int = 4096
) -> DataFrame:
    """``df`` plus ``previous``: struct of ``columns`` of the row before, NULL for the first row.

    Rows are windowed by (keys, position bucket).  Only the last row of each bucket is windowed by
    key alone, so a key with very many rows is spread over its buckets.
    """
    b = df.withColumn("_bucket", F.floor(F.col(position) / bucket))
    row = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position)
    ends = b.groupBy(*keys, "_bucket").agg(F.max_by(row, F.col(position)).alias("_end"))
    carried = ends.select(
        *keys, "_bucket", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carried")
    )
    linked = _joined(b.withColumn("_before", F.lag(row).over(inside)), carried, [*keys, "_bucket"])
    return linked.withColumn("previous", F.coalesce("_before", "_carried")).drop("_before", "_carried", "_bucket")


def with_last_start(
    df: DataFrame, keys: Sequence[str], position: str, starts: Column, column: str, bucket: int = 4096
) -> DataFrame:
    """``df`` plus ``column``: position of the latest row at or before it where ``starts`` holds.

    Bucketed like :func:`with_previous`.
    """
    b = df.withColumn("_bucket", F.floor(F.col(position) / bucket)).withColumn(
        "_start", F.when(starts, F.col(position))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = b.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_top"))
    carried = tops.select(*keys, "_bucket", F.max("_top").over(earlier).alias("_carried"))
    seen = _joined(b.withColumn("_seen", F.max("_start").over(inside)), carried, [*keys, "_bucket"])
    return seen.withColumn(column, F.coalesce("_seen", "_carried")).drop("_seen", "_carried", "_bucket", "_start")


def first_from(starts: DataFrame, keys: DataFrame, partitions: int | None = None) -> DataFrame:
    """The first key at or after every start, in string order: start, key (NULL where there is none).

    ``starts``: one string column ``start``; ``keys``: one string column ``key``; both are made distinct.  An as-of join: starts and keys
    are sorted together by ranges; inside a range the next key is carried back, and the first key of the ranges that follow serves the
    starts at its end.  No row meets more than one other.
    """
    rows = starts.select(F.col("start").alias("_at"), F.lit(0).alias("_kind")).where("_at IS NOT NULL").distinct().unionByName(
        keys.select(F.col("key").alias("_at"), F.lit(1).alias("_kind")).where("_at IS NOT NULL").distinct()
    )
    ranged = rows.repartitionByRange(partitions, "_at", "_kind") if partitions else rows.repartitionByRange("_at", "_kind")
    laid_out = checkpointed(ranged.withColumn("_part", F.spark_partition_id()))
    found = F.when(F.col("_kind") == 1, F.col("_at"))
    later = Window.partitionBy("_part").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    # one row per partition
    firsts = laid_out.groupBy("_part").agg(F.min(found).alias("_first"))
    after = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    following = firsts.select("_part", F.last("_first", ignorenulls=True).over(after).alias("_following"))
    inside = laid_out.withColumn("_next", F.last(found, ignorenulls=True).over(later)).where("_kind = 0")
    return inside.join(F.broadcast(following), "_part").select(F.col("_at").alias("start"), F.coalesce("_next", "_following").alias("key"))
