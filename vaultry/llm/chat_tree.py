"""Chat formatting over a prefix tree: turns that conversations share at their beginning are emitted once, depth first.

A conversation's path is the list of digests of its turns so far.  Conversations sorted by path are in depth-first order of the
tree, and each adds the turns behind those it shares with the one before: its nodes.  A node's tokens have a place in one long
sequence, a position id of the first, and the intervals of the sequence that its ancestors take: what it may attend to besides
itself.  The tree is never gathered: order, places and ancestors come from a range sort, sums by buckets and joins by digest.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import skew
from . import chunks
from .piece_table import PieceTable, resolve
from .shared import plain_offsets, stored, trimmed, work_folder

#: The marks of the template around a turn, and the role that is learnt.
START, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
#: Chunks of texts whose ids a worker keeps, and conversations it takes at a time; bounds on memory only.
KNOWN_PIECES, SLICE_ROWS = 1_000_000, 512

_NODE = "pos long, depth int, digest string, ids array<int>, loss_start int, loss_stop int, offset long, segment long"


@dataclass(frozen=True)
class ChatTree:
    """A written tree: ``nodes`` and ``paths`` are folders, ``tokenizer`` the vocabulary file of the ids."""

    nodes: str
    paths: str
    tokenizer: str


def escaped(text: str) -> str:
    """``text`` without ``<|``: a backslash more stands between the two of every ``<``, backslashes, ``|``."""
    return _MARK.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _head(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role(head: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(head))


@functools.lru_cache(maxsize=2)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, tokenizer.get_vocab_size(), PieceTable(KNOWN_PIECES)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred conversations: a bound on memory."""
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _encoded(texts: list[str], tokenizer) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def ordered(conversations: DataFrame) -> DataFrame:
    """``pos, conv_id, turns array<struct<role, text>>, path array<string>``: a row a conversation, ``pos`` its place depth first.

    Turns of one number stand by role and text, NULL numbers first.  A conversation is one row, as its digest is of its whole text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, inner = plain_offsets(batch.column("turns")), batch.column("turns").flatten()
            roles, texts = inner.field("role").to_pylist(), inner.field("text").to_pylist()
            paths: list[str] = []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                digest = b""
                for role, text in zip(roles[a:b], texts[a:b]):
                    head = role.encode()
                    digest = hashlib.blake2b(digest + b"%d " % len(head) + head + text.encode(), digest_size=16).digest()
                    paths.append(digest.hex())
            at = pa.array(bounds.astype(np.int32))
            turns = pa.StructArray.from_arrays([inner.field("role"), inner.field("text")], ["role", "text"])
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "turns": pa.ListArray.from_arrays(at, turns),
                "path": pa.ListArray.from_arrays(at, pa.array(paths, pa.string())),
            })

    fields = "conv_id long, turns array<struct<role: string, text: string>>, path array<string>"
    rows = whole.mapInArrow(trimmed(run), fields)
    return skew.numbered(rows, [F.col("path"), F.col("conv_id")], "pos")


def _own_turns(convs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for every turn behind the ``shared`` first ones, with its ids and the span of them that is learnt.

    ``offset`` counts the tokens before it among these turns of its conversation, ``segment`` all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, first, table = _library(tokenizer)
        newline = _encoded(["\n"], library)[0]
        heads: dict[str, np.ndarray] = {}
        for batch in _slices(batches):
            bounds, inner = plain_offsets(batch.column("turns")), batch.column("turns").flatten()
            shared = np.asarray(batch.column("shared"))
            depth = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
            own = np.flatnonzero(depth >= np.repeat(shared, np.diff(bounds)))
            part = inner.take(pa.array(own))
            roles = part.field("role").to_pylist()
            new = [r for r in dict.fromkeys(roles) if r not in heads]
            heads.update((r, np.array([first, *ids], np.int32)) for r, ids in zip(new, _encoded([_head(r) + "\n" for r in new], library)))
            texts = pa.array([escaped(t) if "<" in t else t for t in part.field("text").to_pylist()], pa.string())
            flat, at = chunks.encode(texts, lambda w: resolve(w, table, lambda x: _encoded(x, library)))
            tail = np.array([first + 1, *newline], np.int32)
            begin = np.array([len(heads[r]) for r in roles], np.int64)
            stop = begin + np.diff(at)
            total = np.concatenate(([0], np.cumsum(stop + len(tail)))).astype(np.int64)
            ids = np.empty(total[-1], np.int32)
            for role, o, x, y, a_, b_ in zip(roles, total.tolist(), begin.tolist(), stop.tolist(), at.tolist(), at[1:].tolist()):
                ids[o : o + x] = heads[role]
                ids[o + x : o + y] = flat[a_:b_]
                ids[o + y : o + y + len(tail)] = tail
            learnt = np.array([r == LEARNT for r in roles], bool)
            path = batch.column("path").flatten().take(pa.array(own))
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[own]
            begins = total[np.searchsorted(rows, np.arange(len(bounds)))]
            yield pa.RecordBatch.from_pydict({
                "pos": pa.array(np.asarray(batch.column("pos"))[rows]), "depth": pa.array(depth[own].astype(np.int32)),
                "digest": path, "ids": pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(ids)),
                "loss_start": pa.array(np.where(learnt, begin, 0).astype(np.int32)), "loss_stop": pa.array(np.where(learnt, stop, 0).astype(np.int32)),
                "offset": pa.array(total[:-1] - begins[rows]), "segment": pa.array(np.diff(begins)[rows]),
            })

    return convs.select("pos", "shared", "turns", "path").mapInArrow(trimmed(run), _NODE)


def _bases(segments: DataFrame, n: int) -> DataFrame:
    """``pos, base``: the tokens of all segments (``pos, segment``) before each.

    Sums go by buckets: as many places in a bucket as there are buckets.
    """
    width = max(math.isqrt(n), 1)
    dealt = segments.withColumn("_bucket", F.floor(F.col("pos") / width))
    totals = dealt.groupBy("_bucket").agg(F.sum("segment").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a root of n rows
    starts = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_inside", F.coalesce(F.sum("segment").over(inside), F.lit(0))).join(starts, "_bucket")
    return summed.select("pos", (F.col("_start") + F.col("_inside")).alias("base"))


def _merged(spans: DataFrame) -> DataFrame:
    """``pos, position, ancestors``: the tokens of the shared turns of a conversation, and their intervals, merged where they touch."""
    lists = spans.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, inner = plain_offsets(batch.column("spans")), batch.column("spans").flatten()
            start, stop = np.asarray(inner.field("start")), np.asarray(inner.field("stop"))
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            first = np.ones(len(start), bool)
            first[1:] = (text[1:] != text[:-1]) | (start[1:] != stop[:-1])
            heads = np.flatnonzero(first)
            lasts = np.concatenate((heads[1:], [len(start)]))[: len(heads)] - 1
            rows = pa.StructArray.from_arrays([pa.array(start[heads]), pa.array(stop[lasts])], ["start", "stop"])
            at = np.searchsorted(heads, bounds).astype(np.int32)
            total = np.concatenate(([0], np.cumsum(stop - start)))
            yield pa.RecordBatch.from_pydict({
                "pos": batch.column("pos"), "position": pa.array(np.diff(total[bounds])), "ancestors": pa.ListArray.from_arrays(pa.array(at), rows),
            })

    return lists.mapInArrow(trimmed(run), "pos long, position long, ancestors array<struct<start: long, stop: long>>")


def write(conversations: DataFrame, tokenizer: str) -> ChatTree:
    """Format ``conv_id, turn, role, text`` and write two tables.

    ``nodes`` has, in files sorted by ``start``, a row for every different turn in its context: ``start, stop`` (its place in the sequence),
    ``position`` (position id of its first token), ``ancestors`` (intervals it attends to besides itself), ``ids`` and
    ``loss_start, loss_stop`` (the learnt part of ``ids``: an assistant's text).  ``paths`` has ``conv_id, depth, start`` of every turn.
    A turn is its start mark, role, line end, text, end mark, line end.  The marks have the two ids behind the vocabulary; what looks like
    the beginning of a mark in a role or text is escaped.  NULL roles and texts are empty; rows with a NULL ``conv_id`` are one conversation;
    repeated rows are turns of their own; other columns are not read.  An empty table gives empty tables.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    convs = ordered(rows)
    earlier = convs.select((F.col("pos") + 1).alias("pos"), F.col("path").alias("_before"))
    # digests stand for all turns so far: those in common are the shared beginning
    common = F.coalesce(F.size(F.array_intersect("path", "_before")), F.lit(0))
    linked = stored(convs.join(earlier, "pos", "left").withColumn("shared", common).drop("_before"), "chat-conversations")
    own = stored(_own_turns(linked.where(F.size("path") > F.col("shared")), tokenizer), "chat-turns")
    bases = stored(_bases(own.where("offset = 0").select("pos", "segment"), linked.count()), "chat-bases")
    start = F.col("base") + F.col("offset")
    placed = own.join(bases, "pos").withColumns({"start": start, "stop": start + F.size("ids")})
    refs = linked.where("shared > 0").select(
        "pos", "conv_id", F.col("shared") < F.size("path"), F.posexplode(F.slice("path", 1, F.col("shared"))).alias("depth", "digest")
    ).toDF("pos", "conv_id", "adds", "depth", "digest")
    shared = stored(refs.join(placed.select("digest", "start", "stop"), "digest"), "chat-shared")

    folder = work_folder(spark, "chat")
    out = ChatTree(f"{folder}/nodes", f"{folder}/paths", tokenizer)
    ids = linked.select("pos", "conv_id")
    paths = placed.join(ids, "pos").select("conv_id", "depth", "start").unionByName(shared.select("conv_id", "depth", "start"))
    paths.write.parquet(out.paths)

    none = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    joined = placed.join(_merged(shared.where("adds").select("pos", "start", "stop")), "pos", "left")
    joined = joined.withColumn("ancestors", F.coalesce("ancestors", none)).withColumn("_last", F.try_element_at("ancestors", F.lit(-1)))
    touching = F.coalesce(F.col("_last.stop") == F.col("base"), F.lit(False))
    # the conversation's own turns before this one, as one interval with what stands directly before them
    begin = F.when(touching, F.col("_last.start")).otherwise(F.col("base"))
    earlier = F.when(touching, F.slice("ancestors", 1, F.size("ancestors") - 1)).otherwise(F.col("ancestors"))
    grown = F.concat(earlier, F.array(F.struct(begin.alias("start"), F.col("start").alias("stop"))))
    nodes = joined.select(
        "start", "stop", (F.coalesce("position", F.lit(0)) + F.col("offset")).alias("position"),
        F.when(F.col("offset") > 0, grown).otherwise(F.col("ancestors")).alias("ancestors"), "ids", "loss_start", "loss_stop",
    )
    nodes.repartitionByRange("start").sortWithinPartitions("start").write.parquet(out.nodes)
    return out


def read(spark: SparkSession, tree: ChatTree) -> DataFrame:
    """``conv_id, turns array<struct<role, text>>, learnt, formatted_chars`` of every conversation, from the written tokens alone.

    ``learnt`` is all text under the loss mask, unescaped, in order.
    """
    nodes = spark.read.parquet(tree.nodes).select("start", "ids", "loss_start", "loss_stop")
    rows = spark.read.parquet(tree.paths).join(nodes, "start")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "loss_start", "loss_stop"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, first, _ = _library(tree.tokenizer)
        for batch in _slices(batches):
            bounds, inner = plain_offsets(batch.column("nodes")), batch.column("nodes").flatten()
            lists = inner.field("ids")
            at, flat = plain_offsets(lists), lists.flatten().to_numpy(zero_copy_only=False)
            begin, end = np.asarray(inner.field("loss_start")), np.asarray(inner.field("loss_stop"))
            pieces, masked = [], []
            for a, b, lo, hi in zip(at.tolist(), at[1:].tolist(), begin.tolist(), end.tolist()):
                ids = flat[a:b]
                marks = np.flatnonzero(ids >= first)
                if ids[marks].tolist() != [first, first + 1] or marks[0] != 0:
                    raise ValueError("a node is no turn between its marks")
                pieces += [ids[1 : marks[1]].tolist(), ids[marks[1] + 1 :].tolist()]
                masked.append(ids[lo:hi].tolist())
            inside, learnt = library.decode_batch(pieces, skip_special_tokens=False), library.decode_batch(masked, skip_special_tokens=False)
            chars = np.array([len(START) + len(x) + len(END) + len(y) for x, y in zip(inside[::2], inside[1::2])], np.int64)
            heads, bodies = zip(*(x.split("\n", 1) for x in inside[::2])) if pieces else ((), ())
            turns = pa.StructArray.from_arrays(
                [pa.array(map(_role, heads), pa.string()), pa.array(map(unescaped, bodies), pa.string())], ["role", "text"]
            )
            sums = np.concatenate(([0], np.cumsum(chars)))
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "turns": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), turns),
                "learnt": pa.array(["".join(map(unescaped, learnt[a:b])) for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.string()),
                "formatted_chars": pa.array(np.diff(sums[bounds])),
            })

    fields = "conv_id long, turns array<struct<role: string, text: string>>, learnt string, formatted_chars long"
    return whole.mapInArrow(trimmed(run), fields)


def digest(conversations: DataFrame) -> DataFrame:
    """One row for every row of :func:`read`: numbers of turns and code points, digests of all turns and of the learnt text."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return conversations.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1: a user and an assistant who both say what ends a turn and begins another."""
    said = f"{END}{START}assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    more = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)
