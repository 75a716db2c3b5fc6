"""Embedding near-duplicates by NN-descent over balls of close vectors.

Equal vectors are one node.  Nodes within half the threshold's angle of a leader form its ball: all of them are links of one
another by the triangle inequality, so a group of copies of any size costs one entry in the graph.  A neighbour graph over the
leaders starts from random projections and is refined by joins of neighbours of neighbours.  Full lists are enlarged, recall is
audited against brute force for a sample, and the pairs within the threshold are verified vector by vector.  Leaders whose lists are
still full after ``most_rounds`` are compared with all leaders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_sample, stored, trimmed, work_folder

#: Angles closer than this to a bound are decided by comparing vectors.
SLACK = 1e-7


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    tables: int = 8
    fold_bits: int = 12
    neighbours: int = 8
    block_rows: int = 128
    least_rounds: int = 2
    most_rounds: int = 8
    last_rounds: int = 24
    query_rows: int = 4096
    audit_rows: int = 256
    least_recall: float = 0.99
    seed: int = 11

    @property
    def angle(self) -> float:
        return math.acos(self.threshold)


def _planes(settings: Settings, dim: int, bits: int) -> np.ndarray:
    rng = np.random.default_rng([settings.seed, dim])
    return rng.standard_normal((settings.tables, bits, dim)).astype(np.float32)


def _matrices(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of every dimension in a column."""
    bounds = np.asarray(lists.offsets, np.int64)
    dims, values = np.diff(bounds), lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield rows, values[bounds[rows][:, None] + np.arange(dim)]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def unit_vectors(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, u``: unit vectors as doubles; NULL where the vector is null, empty, zero, or not finite throughout."""
    raw = F.col(vector).cast("array<double>")
    sound = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(raw) > 0)
    top = F.array_max(F.transform(raw, F.abs))
    scaled = F.transform(raw, lambda x: x / top)  # the squares of what is left cannot overflow
    narrow = rows.select(F.col(key).cast("long").alias("vec_id"), F.when(sound & (top > 0), scaled).alias("s"))
    length = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return narrow.withColumn("l", length).select("vec_id", F.transform("s", lambda x: x / F.col("l") + 0.0).alias("u"))


def balls(nodes: DataFrame, settings: Settings) -> DataFrame:
    """``node, u, copies, leader, off``: every node with the leader of its ball and the angle between them.

    In each table the node of least id of every bucket of equal signs is offered to the bucket; partial minima
    keep a large bucket from being gathered.  A node takes the least offered leader that is its own leader and close enough.
    """
    half = math.cos(settings.angle / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("node"))
            for rows, matrix in _matrices(batch.column("f")):
                planes = _planes(settings, matrix.shape[1], settings.fold_bits)
                for table in range(settings.tables):
                    signs = (matrix @ planes[table].T > 0) @ (1 << np.arange(settings.fold_bits))
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array(ids[rows]), "bucket": pa.array(signs * settings.tables + table),
                        "dim": pa.array(np.full(len(rows), matrix.shape[1])),
                    })

    floats = nodes.select("node", F.col("u").cast("array<float>").alias("f"))
    keys = stored(floats.mapInArrow(trimmed(run), "node long, bucket long, dim long"), "nn-buckets")
    first = keys.groupBy("dim", "bucket").agg(F.min("node").alias("leader"))
    offers = keys.join(first, ["dim", "bucket"]).where("node > leader").select("node", "leader").distinct()
    own, other = nodes.select("node", "u"), nodes.select(F.col("node").alias("leader"), F.col("u").alias("lu"))
    close = offers.join(own, "node").join(other, "leader").select("node", "leader", _dot(F.col("u"), F.col("lu")).alias("cos"))
    close = stored(close.where(F.col("cos") >= half), "nn-offers")
    led = close.select(F.col("node").alias("leader")).distinct()
    taken = close.join(led, "leader", "left_anti").groupBy("node").agg(F.min(F.struct("leader", "cos")).alias("best"))
    out = nodes.join(taken, "node", "left").select(
        "node", "u", "copies", F.coalesce("best.leader", "node").alias("leader"),
        F.coalesce(_angle(F.col("best.cos")), F.lit(0.0)).alias("off"),
    )
    return stored(out, "nn-balls")


def _best(pairs: DataFrame, sizes: DataFrame | None, k: int) -> DataFrame:
    """The nearest of every list: ``k`` of them, or the list's own size."""
    w = Window.partitionBy("c").orderBy("gap", "d")
    ranked = pairs.groupBy("c", "d").agg(F.min("gap").alias("gap")).withColumn("_n", F.row_number().over(w))
    if sizes is None:
        return ranked.where(F.col("_n") <= k).drop("_n")
    return ranked.join(sizes, "c", "left").where(F.col("_n") <= F.coalesce("k", F.lit(k))).drop("_n", "k")


def _start(centres: DataFrame, settings: Settings) -> DataFrame:
    """Neighbours in the sort orders of random projections."""
    bits = 30

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _matrices(batch.column("f")):
                planes = _planes(settings, matrix.shape[1], bits)
                part = batch.take(pa.array(rows))
                for table in range(settings.tables):
                    signs = (matrix @ planes[table].T > 0) @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_pydict({
                        "place": pa.array((np.int64(matrix.shape[1]) << 40) + (np.int64(table) << 32) + signs), **{n: part.column(n) for n in ("c", "f", "r")}
                    })

    keep, size = max(settings.neighbours // 2, 2), settings.block_rows

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, radius = np.asarray(batch.column("c")), np.asarray(batch.column("r"))
            group = np.asarray(batch.column("place")) >> 32
            for rows, matrix in _matrices(batch.column("f")):
                for table in np.unique(group[rows]):
                    inside = np.flatnonzero(group[rows] == table)
                    for start in range(0, max(len(inside) - size // 2, 1), size // 2):  # blocks overlap by half
                        block = inside[start : start + size]
                        gap = _gaps(matrix[block], radius[rows[block]])
                        np.fill_diagonal(gap, np.inf)
                        n = min(keep, len(block) - 1)
                        if n < 1:
                            continue
                        best = np.argpartition(gap, n - 1, axis=1)[:, :n]
                        own = ids[rows[block]]
                        yield pa.RecordBatch.from_pydict({
                            "c": pa.array(np.repeat(own, n)), "d": pa.array(own[best].ravel()),
                            "gap": pa.array(np.take_along_axis(gap, best, axis=1).ravel().astype(np.float64)),
                        })

    dealt = centres.select("c", "f", "r").mapInArrow(trimmed(keyed), "place long, c long, f array<float>, r double")
    placed = dealt.repartitionByRange("place", "c").sortWithinPartitions("place", "c")
    found = placed.mapInArrow(trimmed(near), "c long, d long, gap double")
    return stored(_best(found, None, settings.neighbours), "nn-start")


def _gaps(matrix: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Angles between all rows less the radii of their balls: what lies between the balls."""
    angle = np.arccos(np.clip(matrix @ matrix.T, -1, 1))
    return angle - radius[:, None] - radius[None, :]


def _improved(lists: DataFrame, centres: DataFrame, sizes: DataFrame | None, settings: Settings) -> DataFrame:
    """One round: the members of every list and of its reverse are compared with one another."""
    k = settings.neighbours
    w = Window.partitionBy("d").orderBy(F.xxhash64("c", "d"))
    # a rank filter keeps k rows for each key and task before the shuffle
    back = lists.select("c", "d").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * k)
    members = (
        lists.select(F.col("c").alias("v"), F.col("d").alias("c")).unionByName(back.select(F.col("d").alias("v"), "c"))
        .unionByName(centres.select(F.col("c").alias("v"), "c")).distinct()
    )
    full = lists.groupBy("c").agg(F.max("gap").alias("worst"), F.count(F.lit(1)).alias("n"))
    if sizes is not None:
        full = full.join(sizes, "c", "left")
    room = F.col("n") < (F.coalesce("k", F.lit(k)) if sizes is not None else F.lit(k))
    reach = full.select("c", F.when(room, F.lit(10.0)).otherwise(F.col("worst")).alias("worst"))
    equipped = stored(centres.select("c", "f", "r").join(reach, "c", "left").fillna(10.0, ["worst"]), "nn-centres")
    groups = members.join(equipped, "c").groupBy("v").agg(F.collect_list(F.struct("c", "f", "r", "worst")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists_ = batch.column("m")
            bounds, inner = np.asarray(lists_.offsets), lists_.values
            ids, radius, worst = (np.asarray(inner.field(n)) for n in ("c", "r", "worst"))
            vectors = inner.field("f")
            at, values = np.asarray(vectors.offsets), np.asarray(vectors.values)
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                if b - a < 2:
                    continue
                gap = _gaps(values[at[a] : at[b]].reshape(b - a, -1), radius[a:b])
                np.fill_diagonal(gap, np.inf)
                i, j = np.nonzero(gap < worst[a:b, None])
                out[0].append(ids[a:b][i])
                out[1].append(ids[a:b][j])
                out[2].append(gap[i, j])
            if out[0]:
                c, d, gap = map(np.concatenate, out)
                yield pa.RecordBatch.from_pydict({"c": pa.array(c), "d": pa.array(d), "gap": pa.array(gap.astype(np.float64))})

    found = groups.mapInArrow(trimmed(run), "c long, d long, gap double")
    return stored(_best(lists.unionByName(found), sizes, k), "nn-lists")


def recall(lists: DataFrame, centres: DataFrame, settings: Settings) -> float:
    """Share of the links of a sample of leaders (by hash) that the lists have; brute force over all leaders."""
    sample = bounded_sample(centres.select("c", "f", "r"), ["c"], settings.audit_rows).collect()
    asked = {r.c: (np.asarray(r.f, np.float32), r.r) for r in sample}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, radius = np.asarray(batch.column("c")), np.asarray(batch.column("r"))
            for rows, matrix in _matrices(batch.column("f")):
                for c, (vector, r) in asked.items():
                    if len(vector) == matrix.shape[1]:
                        gap = np.arccos(np.clip(matrix @ vector, -1, 1)) - radius[rows] - r
                        hit = (gap <= settings.angle) & (ids[rows] != c)
                        yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(hit.sum(), c)), "d": pa.array(ids[rows][hit])})

    true = centres.select("c", "f", "r").mapInArrow(trimmed(run), "c long, d long")
    both = lists.select("c", "d").unionByName(lists.select(F.col("d").alias("c"), F.col("c").alias("d"))).distinct().withColumn("found", F.lit(1))
    n, found = true.join(both, ["c", "d"], "left").agg(F.count(F.lit(1)), F.count("found")).first()
    return found / n if n else 1.0


def _exact(asked: DataFrame, centres: DataFrame, settings: Settings, folder: str) -> None:
    """Adds ``c, d, gap`` of all links of the leaders ``asked`` to ``folder``: one job over all leaders for each ``query_rows`` of them."""
    leaders = centres.select("c", "f", "r")

    def compare(block: list) -> None:
        ids, radii = np.asarray([r.c for r in block], np.int64), np.asarray([r.r for r in block])
        of_dim = {n: [i for i, r in enumerate(block) if len(r.f) == n] for n in {len(r.f) for r in block}}
        queries = {n: (ids[at], np.asarray([block[i].f for i in at], np.float32), radii[at]) for n, at in of_dim.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                others, radius = np.asarray(batch.column("c")), np.asarray(batch.column("r"))
                for rows, matrix in _matrices(batch.column("f")):
                    if matrix.shape[1] not in queries:
                        continue
                    own, vectors, r = queries[matrix.shape[1]]
                    for start in range(0, len(rows), 512):
                        part = rows[start : start + 512]
                        gap = np.arccos(np.clip(matrix[start : start + 512] @ vectors.T, -1, 1)) - radius[part][:, None] - r
                        i, j = np.nonzero((gap <= settings.angle + 1e-3) & (others[part][:, None] != own))
                        yield pa.RecordBatch.from_pydict({"c": pa.array(own[j]), "d": pa.array(others[part][i]), "gap": pa.array(gap[i, j].astype(np.float64))})

        leaders.mapInArrow(trimmed(run), "c long, d long, gap double").write.mode("append").parquet(folder)

    block = []
    for row in leaders.join(asked.select("c"), "c", "left_semi").toLocalIterator():
        block.append(row)
        if len(block) == settings.query_rows:
            compare(block)
            block = []
    if block:
        compare(block)


def graph(centres: DataFrame, settings: Settings) -> DataFrame:
    """``c, d, gap``: neighbour lists of all leaders after refinement.

    Raises if lists are not settled, or audited recall is too low, after ``last_rounds``.
    """
    spark, folder, done = centres.sparkSession, work_folder(centres.sparkSession, "nn-exact"), None
    lists, sizes, k, links, found = _start(centres, settings), None, settings.neighbours, -1, None
    for round_ in range(settings.last_rounds):
        lists = _improved(lists, centres, sizes, settings)
        # lists whose last entry is a link may hide more: they are doubled
        held = lists.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("worst"))
        limit = F.coalesce("k", F.lit(k)) if sizes is not None else F.lit(k)
        held = held.join(sizes, "c", "left") if sizes is not None else held
        growth = 2 if round_ + 1 < settings.most_rounds else 1
        grown = stored(
            held.select("c", limit.alias("k"), ((F.col("n") >= limit) & (F.col("worst") <= settings.angle)).alias("full"))
            .select("c", F.when(F.col("full"), F.col("k") * growth).otherwise(F.col("k")).alias("k"), "full"), "nn-sizes"
        )
        full = grown.where("full") if done is None else grown.where("full").join(done, "c", "left_anti")
        n_full = full.count()
        if growth == 1 and n_full:  # lists grow no more
            _exact(full, centres, settings, folder)
            done = stored(full.select("c") if done is None else full.select("c").unionByName(done), "nn-exact-leaders")
            n_full = 0
        sizes = grown.select("c", "k")
        open_ = lists if done is None else lists.join(done, "c", "left_anti")
        before, links = links, open_.where(F.col("gap") <= settings.angle).count()
        if round_ + 1 < settings.least_rounds or links > before * 1.001 or n_full:
            continue
        whole = open_ if done is None else open_.unionByName(spark.read.schema(lists.schema).parquet(folder))
        found = recall(whole, centres, settings)
        if found >= settings.least_recall:
            return whole
    raise RuntimeError(f"neighbour lists not settled after {settings.last_rounds} rounds; last audited recall: {found}")


def near_duplicates(rows: DataFrame, settings: Settings = Settings(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Links are pairs with cosine (double precision) of at least the threshold.  Vectors that are null, empty, zero, or
    hold null or non-finite components link with nothing; so do vectors of different lengths.  Equal vectors, and rows that repeat a
    ``vec_id``, are links of one another.  A row with a NULL ``vec_id`` has no links and NULL as its component, and is kept.
    Other columns are not read.  An empty table gives an empty result.
    """
    units = stored(unit_vectors(rows, vector, key), "nn-units")
    alive = units.where("u IS NOT NULL AND vec_id IS NOT NULL")
    nodes = stored(alive.groupBy("u").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nn-nodes")
    parts = balls(nodes, settings)
    centres = stored(
        parts.groupBy("leader").agg(F.max("off").alias("r"), F.sum("copies").alias("size"))
        .join(nodes.select(F.col("node").alias("leader"), "u"), "leader")
        .select(F.col("leader").alias("c"), F.col("u").cast("array<float>").alias("f"), "u", "r", "size"), "nn-leaders"
    )
    lists = graph(centres, settings).where(F.col("gap") <= settings.angle + 1e-3)  # single precision so far
    pairs = stored(
        lists.select("c", "d").unionByName(lists.select(F.col("d").alias("c"), F.col("c").alias("d"))).distinct(), "nn-pairs"
    )
    theta = F.lit(settings.angle)
    # every member of a ball against the other ball's leader decides for the whole ball, but near its edge
    far = centres.select(F.col("c").alias("d"), F.col("u").alias("lu"), F.col("r").alias("lr"), F.col("size").alias("ls"))
    mine = parts.select(F.col("leader").alias("c"), "node", "u")
    tried = pairs.join(far, "d").join(mine, "c").withColumn("off", _angle(_dot(F.col("u"), F.col("lu"))))
    tried = stored(tried.where(F.col("off") <= theta + F.col("lr") + SLACK).drop("lu"), "nn-tried")
    sure = (F.col("lr") > 0) & (F.col("off") <= theta - F.col("lr") - SLACK)
    whole = tried.where(sure).select("c", "d", "node", F.col("ls").alias("n"))
    theirs = parts.select(F.col("leader").alias("d"), F.col("u").alias("bu"), F.col("copies").alias("n"))
    single = tried.where(~sure).join(theirs, "d").where(_dot(F.col("u"), F.col("bu")) >= settings.threshold).select("c", "d", "node", "n")
    linked = stored(whole.unionByName(single), "nn-links")
    other = linked.groupBy("node").agg(F.sum("n").alias("n_other"))
    roots = components(linked.select(F.col("c").alias("u"), F.col("d").alias("v")).distinct(), "nn-edges")
    per_node = (
        parts.select("node", "u", "leader").join(centres.select(F.col("c").alias("leader"), "size"), "leader")
        .join(other, "node", "left").join(roots.select(F.col("node").alias("leader"), "component"), "leader", "left")
    ).select(
        "u", (F.col("size") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"), F.coalesce("component", "leader").alias("component_id")
    )
    named = F.col("vec_id").isNotNull()
    found = units.join(per_node, "u", "left").select(
        "vec_id", F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(named, F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return found.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
