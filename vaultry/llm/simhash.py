"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored, text_slices, trimmed

SEED = 42
#: Bits by which linked fingerprints may differ.
DISTANCE = 2
BLOCKS = 4
#: Fingerprints of a block that are compared with one another; fuller blocks are split into smaller ones first.
FULL_BLOCK = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number; bit set where more than half of the shingle hashes have it."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    last = min(shingle, len(words)) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[last:])), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):  # bounded memory for texts of any length
        raw = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, digest, fp`` of every row; NULL and empty texts have fingerprint 0.  Other columns are not read."""
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), _digest(text).alias("digest"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "digest": part.column("digest"),
                    "fp": pa.array([fingerprint(t) for t in part.column("text").to_pylist()], pa.int64()),
                })

    return narrow.mapInArrow(trimmed(run), "doc_id long, digest string, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _halves(mask: int) -> list[int]:
    """Masks that add to ``mask`` two of the four blocks that the other bits are split into.

    Two differing bits lie in at most two blocks, so close fingerprints agree under one of them.
    """
    rest = [b for b in range(64) if not mask >> b & 1]
    size = len(rest) // BLOCKS
    blocks = [sum(1 << b for b in rest[i * size : (i + 1) * size]) for i in range(BLOCKS)]
    return [mask | a | b for a, b in itertools.combinations(blocks, BLOCKS - DISTANCE)]


def _keyed(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select("fp", "rep", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def close_pairs(fps: DataFrame) -> DataFrame:
    """``u, v``: representatives of all different fingerprints (``fp, rep``) at most two bits apart.

    Blocks with up to ``FULL_BLOCK`` fingerprints are compared directly; those of fuller blocks are dealt to blocks
    of fewer free bits (32, then 16, then 8, which 256 fingerprints fill), so no block is ever compared as a whole when
    it is large and no pair is left out.
    """
    levels = [[0]]
    for _ in range(3):
        levels.append(list(dict.fromkeys(m for mask in levels[-1] for m in _halves(mask))))
    level = _keyed(fps, F.array(*[F.lit(_signed(m)).cast("long") for m in levels[1]]))
    found = None
    for depth in (1, 2, 3):
        sizes = level.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(level.join(sizes, ["mask", "part"]), "blocks")
        direct = shared if depth == 3 else shared.where(F.col("n") <= FULL_BLOCK)
        left = direct.select("mask", "part", F.col("fp").alias("a"), F.col("rep").alias("u"))
        right = direct.select("mask", "part", F.col("fp").alias("b"), F.col("rep").alias("v"))
        pairs = (
            left.join(right, ["mask", "part"]).where("a < b")
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("u", "v").distinct()
        )
        found = pairs if found is None else found.unionByName(pairs)
        if depth < 3:
            full = shared.where(F.col("n") > FULL_BLOCK)
            if full.isEmpty():
                break
            below = F.create_map(*[
                x for mask in levels[depth]
                for x in (F.lit(_signed(mask)).cast("long"),
                          F.array(*[F.lit(_signed(m)).cast("long") for m in dict.fromkeys(_halves(mask))]))
            ])
            level = _keyed(full, below[F.col("mask")]).distinct()
    return found.distinct()


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, fingerprint, component_id, n_alike`` of every row.

    Rows with equal fingerprints are one class (``n_alike`` rows); classes at most two bits apart are linked.
    ``component_id`` is the smallest ``doc_id`` reachable.  Texts without words share fingerprint zero and are linked like any
    other.  A row with a NULL ``doc_id`` takes part and has its component's id, NULL where the component has no other.  Rows
    that repeat a ``doc_id`` are each fingerprinted.  An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, text, key).drop("digest"), "fingerprints")
    of = _rooted(prints)
    least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "root").select("fp", "n_alike", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_alike"
    )


def _rooted(prints: DataFrame) -> DataFrame:
    """``fp, rep, n_alike, root`` of every different fingerprint; ``root`` names its group."""
    classes = stored(
        prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_alike")), "classes"
    )
    # a fingerprint is its class's node: it is unique, a doc_id may be repeated or NULL
    nodes = classes.select("fp", F.col("fp").alias("rep"))
    links = components(close_pairs(nodes), "simhash-links")
    return classes.join(links, classes["fp"] == links["node"], "left").select(
        "fp", "rep", "n_alike", F.coalesce("component", "fp").alias("root")
    )


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of every group of linked fingerprints, with the columns of ``docs``: the smallest key, of equal keys one text by its digest.

    Groups are of texts: rows that share a key but no group do not stand for one another.  Rows without a key all stay.
    """
    named = docs.where(F.col(key).isNotNull())
    prints = stored(fingerprints(named, text, key), "fingerprints")
    of = _rooted(prints.drop("digest")).select("fp", "root")
    least = prints.join(of, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    kept = least.select(F.col("least.doc_id").alias("_key"), F.col("least.digest").alias("_digest"))
    rows = named.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("_key"), _digest(text).alias("_digest"))
    # a key and a digest have one fingerprint, so one group; their repeated rows are one
    once = rows.join(kept, ["_key", "_digest"], "left_semi").dropDuplicates(["_key", "_digest"])
    return once.select("_row.*").unionByName(docs.where(F.col(key).isNull()))
