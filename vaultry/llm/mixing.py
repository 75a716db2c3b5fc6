"""Mixing sources to target weights with hash thresholds, without sorting documents.

Every document has a hash that depends on its key alone.  Sizes are summed by source and leading hash bits; the bucket in
which a source's budget ends is found by a running sum over at most 2^10 buckets, and only that bucket is looked at again with ten
more bits, until all 60 bits are used.  A document is taken once more if its hash lies below its source's threshold, so a
larger budget always takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
STEP_BITS = 10
HASH_BITS = 60
#: Sources whose thresholds (some 50 bytes each) are sent to every executor.
BROADCAST_SOURCES = 100_000


def size_of(text: str) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: str) -> Column:
    """The first 60 bits of the MD5 of the key as text; a NULL key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), hash_of(key).alias("hash")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size, target``: all sizes shared by weight, no target above ``most`` times its source's size.

    Weights repeat over the sources by code point, NULL last.  Sources in the order of size by weight are capped
    one after the other until the rest, shared by weight, caps no more: the same as sharing the excess again and again.
    Windows without a partition run over one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = sources.select(
        "source", "source_size", (F.col("source_size") * most).alias("cap"),
        F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("weight"),
    )
    # exact order of cap / weight: ties between equal quotients do not matter
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = weighed.select(
        "*", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("budget"),
        F.sum("weight").over(after).alias("shares"),
    )
    capped = F.col("cap") * F.col("shares") <= F.col("budget") * F.col("weight")
    open_ = F.when(~capped, F.struct(F.col("budget"), F.col("shares")))
    level = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("level").isNull(), F.col("cap").cast("double"))
        .otherwise((F.col("level.budget") * F.col("weight")).cast("double") / F.col("level.shares")).alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` plus ``whole`` (copies of every document) and ``threshold`` (hashes below it are taken once more).

    The taken words of a source are at most its target, and miss it by less than the documents of one hash.
    """
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    state = stored(
        goals.withColumn("whole", whole.cast("long")).select(
            "*", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"),
            F.lit(False).alias("all"),
        ), "mix-targets"
    )
    for used in range(0, HASH_BITS, STEP_BITS):
        rest = HASH_BITS - used
        open_ = state.where(~F.col("all")).select(F.col("source").alias("of"), "prefix", "left")
        inside = sizes.join(open_, F.col("source").eqNullSafe(F.col("of"))).where(F.shiftright("hash", rest) == F.col("prefix"))
        buckets = inside.groupBy("of", "left", F.shiftright("hash", rest - STEP_BITS).alias("bucket")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("of").orderBy("bucket"))
        edge = (
            buckets.withColumn("upto", run).where(F.col("upto") > F.col("left"))
            .groupBy("of").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("below"))).alias("edge"))
        )
        state = stored(
            state.join(edge, F.col("source").eqNullSafe(F.col("of")), "left").select(
                "source", "source_size", "target", "whole",
                (F.col("left") - F.coalesce("edge.below", F.lit(0))).alias("left"),
                F.coalesce("edge.bucket", "prefix").alias("prefix"),
                (F.col("all") | F.col("edge").isNull()).alias("all"),
            ), "mix-edge"
        )
    limit = F.when(F.col("all"), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix"))
    return state.select("source", "source_size", "target", "whole", limit.alias("threshold"))


def plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    return thresholds(sizes, targets(sizes, weights, most))


def _copies() -> Column:
    return (F.col("whole") + (F.col("hash") < F.col("threshold")).cast("long")).alias("copies")


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row.

    A NULL text has size 0, a NULL source is a source of its own, a NULL key is hashed as empty text.  Rows that repeat a key
    share its hash, so all or none of them are taken once more; that is the only tie.  A source without words has target 0 and its
    documents are not taken.  Other columns are not read.  An empty table gives an empty result.
    """
    sizes = stored(sized(docs, text, key, source), "sizes")
    by_source = plan(sizes).withColumnRenamed("source", "of")
    return sizes.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", _copies(), (F.col("size") * F.col("copies")).alias("taken")
    )


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.  Rows of size 0 are kept once.

    Up to ``BROADCAST_SOURCES`` sources texts are not shuffled, beyond that they are joined by source.
    """
    sizes = stored(sized(docs, text, key, source), "sizes")
    by_source = plan(sizes).select(F.struct("source", "whole", "threshold").alias("_mix"))
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    columns = [F.col(c) for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("_row"), size_of(text).alias("_size"), hash_of(key).alias("_hash"))
    joined = row.join(by_source, F.col("_row")[source].eqNullSafe(F.col("_mix.source")))
    times = F.col("_mix.whole") + (F.col("_hash") < F.col("_mix.threshold")).cast("long")
    times = F.when(F.col("_size") == 0, F.lit(1)).otherwise(times).cast("int")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(True), times))).select("_row.*")
