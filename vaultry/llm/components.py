"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u > v").distinct()


def components(edges: DataFrame, name: str = "edges", max_rounds: int = 100) -> DataFrame:
    """``node, component`` (the least node reachable) for every node of ``edges`` (``u, v`` long).

    Hubs are joined and aggregated by partial sums, never gathered.  Every round is written to the shared folder.  Self links
    and repeated or turned-round edges are allowed; rows with a NULL end are left out.  An empty table has no components.
    """
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(*ends).distinct(), name)
    mark = None
    for _ in range(max_rounds):
        now = stored(_small(_large(now)), name)
        # stars that no round changes any more: number, and a sum that depends on every edge
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
