"""Hard negatives by rotated one-bit codes.

A vector is rotated and coded by the signs of its components; its inner product with the code vector, the alignment, is stored,
and what the code leaves over is rotated and coded again.  An anchor's product with a code is a sum of popcounts over the bit planes
of its rotated components.  Alignments times such products estimate the inner product, and the Cauchy-Schwarz inequality bounds what is
missing: the anchor's rounding and the part of the vector that no code holds.  The interval is certain, so whatever
lies outside what is asked for is left out without loss, and the rest is scored in integers.

Anchors are a stated part of the rows; they are read from the shared folder in blocks by every task that holds a block of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import plain_offsets, stored, trimmed, work_folder

#: Components become ``floor(SCALE * x)``; beyond ``MOST`` an inner product might not fit into 64 bits.
SCALE, MOST = 256, 1 << 26


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95
    codes: int = 4
    planes: int = 8
    row_block: int = 1 << 16
    anchor_block: int = 128
    chunk: int = 1 << 13
    score_pairs: int = 1 << 15
    seed: int = 23


@functools.lru_cache(maxsize=8)
def rotations(dim: int, settings: Settings) -> np.ndarray:
    """An orthogonal matrix for every code, of ``dim`` rounded up to whole 64-bit words."""
    size = max(-(-dim // 64), 1) * 64
    rng = np.random.default_rng([settings.seed, size])
    return np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(settings.codes)])


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


def coded(vectors: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes ``(n, codes, words)``, alignments ``(n, codes)`` and the lengths of what is left over."""
    turns = rotations(vectors.shape[1], settings)
    size = turns.shape[1]
    rest = np.zeros((len(vectors), size))
    rest[:, : vectors.shape[1]] = vectors
    bits = np.empty((len(vectors), settings.codes, size // 64), np.uint64)
    aligned = np.empty((len(vectors), settings.codes))
    for i, turn in enumerate(turns):
        rest = rest @ turn.T
        sign = rest >= 0
        bits[:, i] = _words(sign)
        aligned[:, i] = np.abs(rest).sum(axis=1) / np.sqrt(size)
        rest = rest - aligned[:, i, None] * np.where(sign, 1.0, -1.0) / np.sqrt(size)
    return bits, aligned, np.sqrt((rest * rest).sum(axis=1))


@dataclass
class Rows:
    """Vectors of one dimension with their codes."""

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    bits: np.ndarray
    aligned: np.ndarray
    rest: np.ndarray

    def part(self, at: slice) -> Rows:
        return Rows(*(getattr(self, n)[at] for n in ("ids", "labels", "values", "bits", "aligned", "rest")))


class Anchors:
    """A block of anchors, rotated and cut into bit planes for every code."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, settings: Settings):
        self.ids, self.labels, self.values, self.settings = ids, labels, values, settings
        turns = rotations(values.shape[1], settings)
        self.size = turns.shape[1]
        turned = np.zeros((len(ids), self.size))
        turned[:, : values.shape[1]] = values
        self.length = np.sqrt((turned * turned).sum(axis=1))
        self.levels = []
        top = (1 << settings.planes) - 1
        for turn in turns:
            turned = turned @ turn.T
            scale = np.maximum(np.abs(turned).max(axis=1), 1e-300)
            steps = np.rint((turned / scale[:, None] + 1) / 2 * top).astype(np.int64)
            wrong = turned - scale[:, None] * (2 * steps / top - 1)
            planes = np.stack([_words(steps >> b & 1 == 1) for b in range(settings.planes)], axis=1)
            self.levels.append((planes, scale, steps.sum(axis=1), np.sqrt((wrong * wrong).sum(axis=1))))

    def interval(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that the inner product of every anchor with every row can be."""
        top, root = (1 << self.settings.planes) - 1, np.sqrt(self.size)
        estimate = np.zeros((len(self.ids), len(rows.ids)))
        error = np.zeros_like(estimate)
        for i, (planes, scale, total, wrong) in enumerate(self.levels):
            weight = np.zeros(estimate.shape, np.int32)
            for b in reversed(range(self.settings.planes)):
                weight <<= 1
                for w in range(planes.shape[2]):
                    weight += np.bitwise_count(planes[:, b, w, None] & rows.bits[None, :, i, w])
            ones = np.bitwise_count(rows.bits[:, i]).sum(axis=1, dtype=np.int64)
            product = (2 * weight - total[:, None]) * (2 * scale[:, None] / (top * root))
            product -= (2 * ones - self.size)[None, :] * (scale[:, None] / root)
            estimate += rows.aligned[None, :, i] * product
            error += rows.aligned[None, :, i] * wrong[:, None]
            if i == self.settings.codes - 1:  # what is left over is orthogonal to the last code
                along = np.maximum(np.abs(product) - wrong[:, None], 0)
                error += np.sqrt(np.maximum(self.length[:, None] ** 2 - along * along, 0)) * rows.rest[None, :]
        norm = np.sqrt((rows.aligned**2).sum(axis=1) + rows.rest**2)
        error += 1e-9 * self.length[:, None] * norm[None, :] + 1e-6  # of floating point
        return estimate - error, estimate + error

    def scores(self, rows: Rows, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Integer inner products of the pairs that are left."""
        out = np.empty(len(anchor), np.int64)
        step = self.settings.score_pairs
        for at in range(0, len(anchor), step):
            part = slice(at, at + step)
            out[part] = np.einsum("ij,ij->i", self.values[anchor[part]], rows.values[row[part]])
        return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th largest of every row; less than anything where a row is shorter."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of every group, by score downwards, then id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    head = np.concatenate(([True], g[1:] != g[:-1]))[: len(g)]
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
    return order[rank < k]


def _cut(kept: list[np.ndarray], new: list[np.ndarray], k: int) -> list[np.ndarray]:
    """``group, id, score`` of both, the first ``k`` of every group."""
    both = [np.concatenate(x) for x in zip(kept, new)]
    chosen = _first(both[0], both[2], both[1], k)
    return [x[chosen] for x in both]


def _reached(kept: list[np.ndarray], groups: int, k: int) -> np.ndarray:
    """The ``k``-th best score so far of every group; less than anything where there are fewer."""
    out = np.full(groups, -np.inf)
    counts = np.bincount(kept[0], minlength=groups)
    least = np.full(groups, np.inf)
    np.minimum.at(least, kept[0], kept[2])
    out[counts >= k] = least[counts >= k]
    return out


_EMPTY = [np.zeros(0, np.int64)] * 3


def nearest_alike(anchors: Anchors, rows: Rows, settings: Settings) -> list[np.ndarray]:
    """``anchor's number, vec_id, score`` of the first rows of each anchor's label in this block."""
    kept, k = _EMPTY, settings.positives
    for at in range(0, len(rows.ids), settings.chunk):
        part = rows.part(slice(at, at + settings.chunk))
        alike = (anchors.labels[:, None] == part.labels[None, :]) & (anchors.ids[:, None] != part.ids[None, :])
        low, high = anchors.interval(part)
        least = np.maximum(_kth(np.where(alike, low, -np.inf), k), _reached(kept, len(anchors.ids), k))
        a, r = np.nonzero(alike & (high >= least[:, None]))
        kept = _cut(kept, [a, part.ids[r], anchors.scores(part, a, r)], k)
    return kept


def within_windows(anchors: Anchors, rows: Rows, least: np.ndarray, most: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """``anchor's number * positives + window, vec_id, score`` of the first rows of other labels with a score in the window.

    ``least, most (anchors, positives)``: windows; an empty one has ``least > most``.
    """
    kept, k, windows = _EMPTY, settings.negatives, least.shape[1]
    for at in range(0, len(rows.ids), settings.chunk):
        part = rows.part(slice(at, at + settings.chunk))
        other = anchors.labels[:, None] != part.labels[None, :]
        low, high = anchors.interval(part)
        reached = _reached(kept, len(anchors.ids) * windows, k).reshape(-1, windows)
        asked = np.zeros(other.shape, bool)
        for j in range(windows):
            lo, hi = least[:, j, None], most[:, j, None]
            certain = other & (low >= lo) & (high <= hi)
            bar = np.maximum(_kth(np.where(certain, low, -np.inf), k), reached[:, j])[:, None]
            asked |= other & (high >= np.maximum(lo, bar)) & (low <= hi) & (lo <= hi)
        a, r = np.nonzero(asked)
        score = anchors.scores(part, a, r)
        inside = (score[:, None] >= least[a]) & (score[:, None] <= most[a])
        pair, j = np.nonzero(inside)
        kept = _cut(kept, [a[pair] * windows + j, part.ids[r[pair]], score[pair]], k)
    return kept


_CODED = "vec_id long, label long, dim int, anchor boolean, v binary, bits binary, aligned binary, rest double"
_ASKED = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()),
                    ("positives", pa.list_(pa.struct([("positive_id", pa.int64()), ("score", pa.int64())])))])


def vectors(rows: DataFrame, anchor: Column, settings: Settings, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Integer components and codes of every row that takes part, spread evenly; see :func:`mine`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = plain_offsets(batch.column("e"))
            flat = batch.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL becomes NaN
            dims = np.diff(bounds)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                with np.errstate(invalid="ignore", over="ignore"):
                    v = np.floor(SCALE * flat[bounds[at][:, None] + np.arange(dim)])
                sound = (np.abs(v) <= MOST).all(axis=1)
                at, v = at[sound], v[sound].astype(np.int64)
                bits, aligned, rest = coded(v, settings)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("vec_id"), "label": part.column("label"), "dim": pa.array(np.full(len(at), dim, np.int32)),
                    "anchor": part.column("anchor"), "v": pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()),
                    "bits": pa.array([x.tobytes() for x in bits], pa.binary()), "aligned": pa.array([x.tobytes() for x in aligned], pa.binary()),
                    "rest": pa.array(rest),
                })

    part = rows.where(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("e"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    row = F.struct("label", "dim", "v", "anchor", "bits", "aligned", "rest")
    once = part.mapInArrow(trimmed(run), _CODED).groupBy("vec_id").agg(F.min(row).alias("_row")).select("vec_id", "_row.*")
    # the work is the comparisons: as many parts as keep all cores busy, not as many as the bytes would make
    parts = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return stored(once.repartition(parts, "vec_id"), "negatives-vectors")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), kind)
    return raw.reshape(len(column), -1)


def _searched(rows: DataFrame, asked: str, search, schema: str, settings: Settings) -> DataFrame:
    """``search(anchors, batch of anchors, rows)`` for every block of rows with every block of the anchors stored in ``asked``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= settings.row_block:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(asked)
        for table in blocks(batches):
            for dim in pc.unique(table["dim"]).to_pylist():
                part = table.filter(pc.equal(table["dim"], dim)).combine_chunks()
                bits = _matrix(part["bits"], "<u8").reshape(len(part), settings.codes, -1)
                block = Rows(
                    np.asarray(part["vec_id"]), np.asarray(part["label"]), _matrix(part["v"], "<i4").reshape(len(part), dim).astype(np.int64),
                    bits, _matrix(part["aligned"], "<f8"), np.asarray(part["rest"]),
                )
                files = ds.dataset(root, _ASKED, format="parquet", filesystem=store)
                for some in files.to_batches(filter=ds.field("dim") == dim, batch_size=settings.anchor_block, use_threads=False, batch_readahead=1, fragment_readahead=1):
                    for at in range(0, len(some), settings.anchor_block):
                        few = some.slice(at, settings.anchor_block)
                        values = _matrix(few["v"], "<i4").reshape(len(few), dim).astype(np.int64)
                        anchors = Anchors(np.asarray(few["vec_id"]), np.asarray(few["label"]), values, settings)
                        found = search(anchors, few, block)
                        if len(found["score"]):
                            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

    return rows.mapInArrow(trimmed(run), schema)


def positives(rows: DataFrame, settings: Settings) -> DataFrame:
    """``anchor_id, positive_id, score, place``: the first other rows of each anchor's label, from the rows of :func:`vectors`."""
    asked = work_folder(rows.sparkSession, "negatives-anchors")
    none = F.array().cast("array<struct<positive_id: bigint, score: bigint>>")
    rows.where("anchor").select("vec_id", "label", "dim", "v", none.alias("positives")).write.parquet(asked)

    def search(anchors: Anchors, few: pa.RecordBatch, block: Rows) -> dict[str, np.ndarray]:
        a, ids, score = nearest_alike(anchors, block, settings)
        return {"anchor_id": anchors.ids[a], "positive_id": ids, "score": score}

    found = _searched(rows, asked, search, "anchor_id long, positive_id long, score long", settings)
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    return stored(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= settings.positives), "negatives-positives")


def mine(rows: DataFrame, anchor: Column, settings: Settings = Settings(), vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    A score is the inner product of two rows' integers ``floor(256 x)``; higher ones come first, ties by ``vec_id``.  An anchor's positives
    are its first ``positives`` other rows of the same label, and for each of them the first ``negatives`` rows of other labels whose score
    is ``least_percent`` to ``most_percent`` of the positive's are returned, so none where the positive's score is below 0.

    Rows take no part whose ``vec_id``, label or vector is NULL, or with a component that is NULL, not finite, or beyond ``MOST`` after
    scaling.  Of several rows with one ``vec_id`` that of the least label, dimension and integers (as bytes) counts.  Only vectors of one dimension are
    compared; an empty vector's scores are 0.  An empty table has no negatives.  Other columns are not read.
    """
    spark = rows.sparkSession
    taken = vectors(rows, anchor, settings, vector, label)
    first = positives(taken, settings)
    asked = work_folder(spark, "negatives-windows")
    lists = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("positives"))  # few an anchor
    anchors = taken.where("anchor").select("vec_id", "label", "dim", "v")
    anchors.join(lists.withColumnRenamed("anchor_id", "vec_id"), "vec_id").write.parquet(asked)
    width = settings.positives

    def search(block_of: Anchors, few: pa.RecordBatch, block: Rows) -> dict[str, np.ndarray]:
        bounds, inner = plain_offsets(few["positives"]), few["positives"].flatten()
        score = np.zeros((len(few), width), np.int64)
        ids, real = np.zeros_like(score), np.arange(width)[None, :] < np.diff(bounds)[:, None]
        score[real], ids[real] = np.asarray(inner.field("score")), np.asarray(inner.field("positive_id"))
        least = -((-settings.least_percent * score) // 100)
        most = np.where(real, settings.most_percent * score // 100, least - 1)
        group, found, got = within_windows(block_of, block, least, most, settings)
        a, j = group // width, group % width
        return {"anchor_id": block_of.ids[a], "positive_id": ids[a, j], "positive_score": score[a, j], "negative_id": found, "score": got}

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"
    found = _searched(taken, asked, search, schema, settings)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= settings.negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def with_moved_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with every seventh ``vec_id``'s label moved on by one, modulo 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))
