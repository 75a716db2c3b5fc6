"""Language-model scores by a weighted backoff automaton.

The tokens of all training documents are counted.  Words, pairs and triples that occur twice are kept, their probabilities smoothed by an
absolute discount.  Kept words and pairs are states; a kept pair is an arc from its first word, a kept triple one from its first pair, with
a log probability; it leads to the pair that it ends in.  A failure arc leads from a pair to its second word and from a word to the empty state, at the price
of the backoff weight.  The automaton is compiled into sorted arrays in files below the shared folder, which scoring tasks map into
memory; it grows with the corpus, and no process reads more of it than its texts need.

A text is scored by one traversal from left to right that carries the state.  Many stretches of text go side by side; a long text is
cut into stretches that begin two words early, since a state holds two words at most and nothing further back can reach it.

Documents are coded in blocks of some megabytes, each with its own list of words and the texts as numbers.  Only a block's different
words, pairs and triples with their counts are sent, once each.  Words go by hashes of 64 bits: among ``n`` different ones about
``n * n / 2**65`` pairs share a hash and are counted together.  Pairs and triples are exact.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod5, stored, text_slices, texts_of, trimmed, words_of, work_folder

#: Stands for the end of a text; no word has a line feed.
END = "\n"
BLOCK_BYTES = 8 << 20
#: About as many entries of all blocks meet in a shard, and about as many lie in a compiled file.
SHARD_ENTRIES, FILE_ENTRIES = 1 << 21, 1 << 26
#: Blocks whose keys show how to cut the shards (their sizes, not what is counted), and keys taken of each.
SAMPLE_BLOCKS, SAMPLE_KEYS = 64, 4096
#: Tokens of a stretch that goes through the automaton, without the words it begins early.
STRETCH = 512


@dataclass(frozen=True)
class Settings:
    """Words that can be contexts and n-grams are kept from ``least_count`` training occurrences on, at every size.

    ``word_share`` and ``gram_share`` raise that to a share of the training tokens, for models of bounded size.
    """

    order: int = 3
    least_count: int = 2
    word_share: float = 0.0
    gram_share: float = 0.0
    discount: float = 0.75


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _hashed(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _least(settings: Settings, share: float, tokens: int) -> int:
    return max(settings.least_count, math.ceil(share * tokens))


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES, words: bool = True) -> DataFrame:
    """One row for each block: the documents' ids, folds and lengths, their tokens as numbers, and the block's words.

    ``counts`` has the training occurrences of every word of the block; the words themselves, which only :func:`fit` needs, can be left
    out, their hashes stay.  The rows are stored, so blocks keep their numbers.
    """
    narrow = docs.select(F.col(key).alias("doc_id"), (crc_mod5(key) == 1).alias("held_out"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    keep_words = words

    def close(parts: list, number: int) -> pa.RecordBatch:
        words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        lengths = np.concatenate([p[1] for p in parts])
        ids, held = (pa.concat_arrays([p[k] for p in parts]) for k in (2, 3))
        size = len(words.dictionary)
        ends = np.cumsum(lengths + 1)
        codes = np.full(ends[-1], size, np.int32)  # the last code is the end of a text
        place = np.ones(len(codes), bool)
        place[ends - 1] = False
        codes[place] = np.asarray(words.indices, np.int32)
        training = np.repeat(~np.asarray(held), lengths + 1)
        counts = np.bincount(codes[training], minlength=size + 1)
        vocabulary = pa.concat_arrays([words.dictionary, pa.array([END])])
        number = TaskContext.get().partitionId() << 32 | number
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number]), "ids": one(ids), "held": one(held), "lengths": one(pa.array(lengths + 1)),
            "codes": pa.array([_packed(codes)], pa.binary()), "words": one(vocabulary if keep_words else vocabulary[:0]), "counts": one(pa.array(counts)),
            "hashes": pa.array([_packed(_hashed(vocabulary.to_pylist()))], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = pc.ascii_lower(texts_of(part))
                words, counts = words_of(texts)
                parts.append((words, counts, part.column("doc_id"), part.column("held_out")))
                held += texts.nbytes
                if held >= block_bytes:
                    yield close(parts, number)
                    parts, held, number = [], 0, number + 1
        if parts:
            yield close(parts, number)

    schema = (
        f"block long, ids array<{kind}>, held array<boolean>, lengths array<long>, codes binary, words array<string>, counts array<long>, hashes binary"
    )
    return stored(narrow.mapInArrow(trimmed(run), schema), "lm-blocks")


def _log10(count, tokens: int, different: int):
    return np.log10((count + 0.5) / (tokens + 0.5 * (different + 1)))


# stored arrays ---------------------------------------------------------------------------------
def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays as a file, complete under its name; a task that is repeated finds the equal file there."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    path, part = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        for array in arrays:
            if len(array):
                out.write(pa.py_buffer(np.ascontiguousarray(array)))
    if store.get_file_info(path).type == fs.FileType.NotFound:
        store.move(part, path)
    else:
        store.delete_file(part)


@functools.lru_cache(maxsize=512)
def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, kind, "r"))
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


@dataclass(frozen=True)
class Table:
    """Arrays by the order of their ``keys``, in files: where each begins, its first key, and the kind of every column."""

    folder: str
    name: str
    starts: tuple[int, ...]
    firsts: tuple[int, ...]
    n: int
    columns: tuple[tuple[str, str], ...]

    def column(self, name: str, file: int) -> np.ndarray:
        return _mapped(self.folder, f"{self.name}-{name}-{file}", dict(self.columns)[name])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are not there."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        file_of = np.maximum(np.searchsorted(np.asarray(self.firsts, np.uint64), keys, side="right") - 1, 0) if len(self.starts) > 1 else None
        for file in range(len(self.starts)) if file_of is None else np.unique(file_of):
            here = slice(None) if file_of is None else np.flatnonzero(file_of == file)
            there, wanted = self.column("keys", int(file)), keys[here]
            at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
            out[here] = np.where(there[at] == wanted, at + self.starts[file], -1)
        return out

    def take(self, name: str, places: np.ndarray) -> np.ndarray:
        if len(self.starts) == 1:
            return self.column(name, 0)[places]
        out = np.zeros(len(places), dict(self.columns)[name])
        if len(places):
            file_of = np.searchsorted(np.asarray(self.starts), places, side="right") - 1
            for file in np.unique(file_of):
                here = np.flatnonzero(file_of == file)
                out[here] = self.column(name, int(file))[places[here] - self.starts[file]]
        return out


def _gathered(frame: DataFrame, emit: Callable, finish: Callable, entries: int, folder: str, name: str, columns: tuple) -> tuple[Table, int]:
    """Sums of ``emit(batch, i) -> keys, values`` over all rows, as a table of what ``finish(keys, sums)`` keeps; and the number of keys.

    ``keys`` are sorted and different in a row of ``frame``; shards are ranges of keys of about equal weight, so a context with very many
    continuations is cut as well.  ``finish`` returns the arrays of ``columns``, keys first.
    """
    spark = frame.sparkSession
    shards = 1 + entries // SHARD_ENTRIES
    edges = _edges(frame, emit, shards)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, values = emit(batch, i)
                bounds = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if b > a:
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([k], pa.int32()), "keys": pa.array([_packed(np.diff(keys[a:b], prepend=np.uint64(0)))], pa.binary()),
                            "values": pa.array([_packed(values[:, a:b])], pa.binary()), "kind": pa.array([values.dtype.str]),
                        })

    def meet(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        parts = [np.cumsum(_unpacked(keys, np.uint64), dtype=np.uint64) for keys, _, _ in rows]
        values = np.concatenate([_unpacked(v, np.dtype(kind)).reshape(-1, len(p)) for p, (_, v, kind) in zip(parts, rows)], axis=1)
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(values[:, order].astype(np.float64), heads, axis=1)
        kept = finish(keys[heads], sums)
        for (column, kind), array in zip(columns, kept):
            _write(f"{folder}/{name}", f"{column}.{shard}", np.asarray(array).astype(kind))
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "n": pa.array([len(kept[0])], pa.int64()), "seen": pa.array([int((sums[0] > 0).sum())], pa.int64()),
            "first": pa.array([str(kept[0][0]) if len(kept[0]) else "0"]),
        })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "keys", "values", "kind"))):
                if shard is not None and row[0] != shard:
                    yield meet(shard, rows)
                    rows = []
                shard = row[0]
                rows.append(row[1:])
        if rows:
            yield meet(shard, rows)

    sent = frame.mapInArrow(trimmed(cut), "shard int, keys binary, values binary, kind string")
    dealt = sent.repartition(shards, "shard").sortWithinPartitions("shard")
    made = stored(dealt.mapInArrow(trimmed(merge), "shard int, n long, seen long, first string"), f"lm-{name}")
    found = sorted(made.collect())  # a row for every shard
    return _compiled(spark, folder, name, columns, [(r.shard, r.n, int(r.first)) for r in found if r.n]), sum(r.seen for r in found)


def _edges(frame: DataFrame, emit: Callable, shards: int) -> np.ndarray:
    """Keys that cut what a sample of rows emits into equal parts."""
    if shards == 1:
        return np.zeros(0, np.uint64)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, _ = emit(batch, i)
                if len(keys):
                    taken = keys[np.linspace(0, len(keys) - 1, min(len(keys), SAMPLE_KEYS)).astype(np.int64)]
                    yield pa.RecordBatch.from_pydict({"keys": pa.array([taken.tobytes()], pa.binary())})

    rows = bounded_sample(frame, ["block"], SAMPLE_BLOCKS).mapInArrow(trimmed(some), "keys binary").collect()
    keys = np.sort(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])) if rows else np.zeros(1, np.uint64)
    return np.unique(keys[np.arange(1, shards) * len(keys) // shards])


def _compiled(spark: SparkSession, folder: str, name: str, columns: tuple, shards: list[tuple[int, int, int]]) -> Table:
    """Shards (number, size, first key) in order put together into few large files."""
    files, starts, firsts, total = [], [], [], 0
    for shard, n, first in shards:
        if not files or total + n - starts[-1] > FILE_ENTRIES:
            files.append([])
            starts.append(total)
            firsts.append(first)
        files[-1].append(shard)
        total += n
    _joined(spark, folder, name, name, columns, files)
    return Table(folder, name, tuple(starts), tuple(firsts), total, columns)


def _joined(spark: SparkSession, folder: str, shards: str, name: str, columns: tuple, files: list[list[int]]) -> None:
    """The columns of a table's files, each from its shards; these are dropped afterwards."""
    jobs = [(column, kind, k, part) for column, kind in columns for k, part in enumerate(files)]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, kind, k, part in zip(*(batch.column(c).to_pylist() for c in ("column", "kind", "k", "part"))):
                _write(folder, f"{name}-{column}-{k}", *(_mapped.__wrapped__(f"{folder}/{shards}", f"{column}.{x}", kind) for x in part))
            yield batch.select(["k"])  # not kept mapped: what is deleted would stay on disk

    if jobs:
        frame = spark.createDataFrame(jobs, "column string, kind string, k int, part array<int>").repartition(len(jobs))
        frame.mapInArrow(join, "k int").count()
    _dropped(spark, f"{folder}/{shards}")


def _dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _pieces(spark: SparkSession, table: Table) -> DataFrame:
    """Stretches of a table's files as rows: block, file, begin, end."""
    rows = []
    for file, n in enumerate(np.diff([*table.starts, table.n]).tolist() if table.n else []):
        rows += [(len(rows) + k, file, a, min(a + SHARD_ENTRIES, n)) for k, a in enumerate(range(0, n, SHARD_ENTRIES))]
    frame = spark.createDataFrame(rows, "block long, file int, begin long, end long")
    return frame.repartition(max(len(rows), 1), "block")


def _piece(batch: pa.RecordBatch, i: int) -> tuple[int, int, int, int]:
    return tuple(batch.column(c)[i].as_py() for c in ("block", "file", "begin", "end"))


def _extended(spark: SparkSession, table: Table, columns: tuple, compute: Callable) -> Table:
    """A table with more columns: ``compute(piece, keys, counts)`` gives their arrays for a stretch."""
    folder, shards = table.folder, f"{table.name}-more"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, file, a, b = _piece(batch, i)
                arrays = compute(block, table.column("keys", file)[a:b], table.column("count", file)[a:b])
                for (column, kind), array in zip(columns, arrays):
                    _write(f"{folder}/{shards}", f"{column}.{block}", np.asarray(array).astype(kind))
                yield pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int64())})

    made = sorted(_pieces(spark, table).mapInArrow(trimmed(run), "file int, block long").collect())  # a row for every stretch
    files: list[list[int]] = [[] for _ in table.starts]
    for r in made:
        files[r.file].append(r.block)
    _joined(spark, folder, shards, table.name, columns, files)
    return Table(folder, table.name, table.starts, table.firsts, table.n, (*table.columns, *columns))


# the model -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """Tables by word hash, word number, pair and triple, and the totals of training.

    ``words``: count and number (-1 for words that are no contexts); ``kept``: counts of the numbered words; ``pairs`` and ``triples``: arcs; a pair's
    place is its number; ``word_weights``, ``pair_weights``: backoff weights by number, where there is one.
    """

    tokens: int
    different: int
    width: int
    words: Table
    kept: Table
    pairs: Table
    triples: Table
    word_weights: Table
    pair_weights: Table

    def single(self, counts: np.ndarray) -> np.ndarray:
        return _log10(counts.astype(float), self.tokens, self.different)

    def weight(self, table: Table, numbers: np.ndarray) -> np.ndarray:
        at = table.find(numbers.astype(np.uint64))
        return np.where(at >= 0, table.take("weight", np.maximum(at, 0)) if table.n else 0.0, 0.0)


@dataclass(frozen=True)
class _Block:
    """A block's tokens: counts and numbers of their words, texts' bounds, and what is training."""

    counts: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    training: np.ndarray


def _block(batch: pa.RecordBatch, i: int, words: Table) -> _Block:
    codes = _unpacked(batch.column("codes")[i].as_py(), np.int32)
    at = words.find(_unpacked(batch.column("hashes")[i].as_py(), np.uint64))
    there = np.maximum(at, 0)
    counts = np.where(at >= 0, words.take("count", there) if words.n else 0, 0)[codes]
    numbers = np.where(at >= 0, words.take("number", there) if words.n else -1, -1)[codes]
    lengths = np.asarray(batch.column("lengths")[i].values, np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    held = batch.column("held")[i].values.to_numpy(zero_copy_only=False).astype(bool)
    return _Block(counts, numbers, lengths, text, ~held[text])


def _pairs(block: _Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of training tokens that end a pair of numbered words, and the pairs' keys."""
    a, b = block.numbers[:-1], block.numbers[1:]
    at = np.flatnonzero((a >= 0) & (b >= 0) & (block.text[:-1] == block.text[1:]) & block.training[1:])
    return at + 1, a[at].astype(np.uint64) * np.uint64(width) + b[at].astype(np.uint64)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, counts = np.unique(keys, return_counts=True)
    return different, counts.astype(np.int32)[None]


def fit(coded: DataFrame, settings: Settings = Settings()) -> Model:
    """Count the training documents of :func:`blocks` and compile the automaton."""
    spark = coded.sparkSession
    folder = work_folder(spark, "lm-automaton")
    size = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    tokens, whole = (x or 0 for x in coded.select(size("counts"), size("lengths")).first())
    least, often = _least(settings, settings.word_share, tokens), _least(settings, settings.gram_share, tokens)
    discount = settings.discount

    def word_counts(batch: pa.RecordBatch, i: int):
        hashes = _unpacked(batch.column("hashes")[i].as_py(), np.uint64)
        counts = np.asarray(batch.column("counts")[i].values, np.int64)
        order = np.flatnonzero(counts)[np.argsort(hashes[counts > 0], kind="stable")]
        return hashes[order], counts[order][None]

    counted, different = _gathered(
        coded.select("block", "hashes", "counts"), word_counts, lambda keys, sums: (keys, sums[0]), whole, folder, "words", (("keys", "<u8"), ("count", "<i8"))
    )
    words, kept = _numbered(spark, counted, least)
    width = max(kept.n, 1)
    if kept.n and kept.n * max(whole, 1) >= 1 << 63:
        raise ValueError("too many words and pairs for keys of 64 bits")

    arcs = (("keys", "<u8"), ("count", "<i8"))
    narrow = coded.select("block", "codes", "hashes", "lengths", "held")

    def frequent(keys: np.ndarray, sums: np.ndarray):
        enough = sums[0] >= often
        return keys[enough], sums[0][enough]

    def pair_counts(batch: pa.RecordBatch, i: int):
        return _counted(_pairs(_block(batch, i, words), width)[1])

    none = Table(folder, "none", (), (), 0, arcs)
    pairs = _gathered(narrow, pair_counts, frequent, whole, folder, "pairs", arcs)[0] if settings.order > 1 else none

    def triple_counts(batch: pa.RecordBatch, i: int):
        block = _block(batch, i, words)
        at, keys = _pairs(block, width)
        number = np.full(len(block.numbers), -1, np.int64)
        unique, of = np.unique(keys, return_inverse=True)
        number[at] = pairs.find(unique)[of]
        end = at[(number[at] >= 0) & (number[at - 1] >= 0) & (block.text[at - 1] == block.text[at])]
        return _counted(number[end - 1].astype(np.uint64) * np.uint64(width) + block.numbers[end].astype(np.uint64))

    triples = _gathered(narrow, triple_counts, frequent, whole, folder, "triples", arcs)[0] if settings.order > 2 and pairs.n else none

    # contexts of the arcs, their probabilities, and those of the same words one order below
    def pair_arcs(keys: np.ndarray, counts: np.ndarray):
        a, b = (keys // np.uint64(width)).astype(np.int64), (keys % np.uint64(width)).astype(np.int64)
        below = 10 ** _log10(kept.take("count", b).astype(float), tokens, different)
        return a, (counts - discount) / kept.take("count", a), below

    def triple_arcs(keys: np.ndarray, counts: np.ndarray):
        p, c = (keys // np.uint64(width)).astype(np.int64), keys % np.uint64(width)
        b = pairs.take("keys", p) % np.uint64(width)
        after = pairs.find(b * np.uint64(width) + c)  # a kept triple's last pair is kept
        below = (pairs.take("count", after) - discount) / kept.take("count", b.astype(np.int64))
        return p, (counts - discount) / pairs.take("count", p), below

    pairs, word_weights = _weighed(spark, pairs, pair_arcs)
    triples, pair_weights = _weighed(spark, triples, triple_arcs)
    return Model(tokens, different, width, words, kept, pairs, triples, word_weights, pair_weights)


def _numbered(spark: SparkSession, counted: Table, least: int) -> tuple[Table, Table]:
    """Words with numbers, in the order of their hashes, for those of ``least`` occurrences; and the table of these words' counts by number."""
    folder = counted.folder
    if not counted.n:
        return counted, Table(folder, "kept", (), (), 0, (("count", "<i8"),))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, file, a, b = _piece(batch, i)
                count = counted.column("count", file)[a:b]
                _write(f"{folder}/kept", f"count.{block}", count[count >= least])
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n": pa.array([int((count >= least).sum())], pa.int64())})

    sizes = sorted(_pieces(spark, counted).mapInArrow(trimmed(sized), "block long, n long").collect())  # a row for every stretch
    begins = np.concatenate(([0], np.cumsum([r.n for r in sizes]))).astype(int).tolist()

    def numbers(block: int, keys: np.ndarray, counts: np.ndarray):
        enough = counts >= least
        return (np.where(enough, begins[block] + np.cumsum(enough) - 1, -1),)

    kept = _compiled(spark, folder, "kept", (("count", "<i8"),), [(r.block, r.n, begins[r.block]) for r in sizes if r.n])
    return _extended(spark, counted, (("number", "<i8"),), numbers), kept


def _weighed(spark: SparkSession, arcs: Table, arcs_of: Callable) -> tuple[Table, Table]:
    """A table of arcs with log probabilities, and the backoff weights of the contexts they leave from."""
    weights = (("keys", "<u8"), ("weight", "<f4"))
    if not arcs.n:
        return arcs, Table(arcs.folder, f"{arcs.name}-none", (), (), 0, weights)

    def emit(batch: pa.RecordBatch, i: int):
        _, file, a, b = _piece(batch, i)
        context, taken, below = arcs_of(arcs.column("keys", file)[a:b], arcs.column("count", file)[a:b])
        different, of = np.unique(context, return_inverse=True)
        return different.astype(np.uint64), np.stack([np.bincount(of, x, len(different)) for x in (taken, below)])

    def finish(keys: np.ndarray, sums: np.ndarray):
        return keys, np.log10(np.maximum(1 - sums[0], 1e-12) / np.maximum(1 - sums[1], 1e-12))

    def arrays(block: int, keys: np.ndarray, counts: np.ndarray):
        return (np.log10(arcs_of(keys, counts)[1]),)

    found, _ = _gathered(_pieces(spark, arcs), emit, finish, arcs.n, arcs.folder, f"{arcs.name}-weights", weights)
    return _extended(spark, arcs, (("log10", "<f4"),), arrays), found


@dataclass(frozen=True)
class _Arcs:
    """What the automaton has for every token of a block: the arc that leads over it from the word before and from the pair before (-1: none, so the
    failure arc is taken), their log probabilities, and the backoff weights of the word and of the pair that end here."""

    numbers: np.ndarray
    singles: np.ndarray
    pair: np.ndarray
    pair_log10: np.ndarray
    triple: np.ndarray
    triple_log10: np.ndarray
    word_weight: np.ndarray
    pair_weight: np.ndarray


def _found(table: Table, keys: np.ndarray) -> np.ndarray:
    """Places of keys that repeat: each different one is looked for once, in order."""
    unique, of = np.unique(keys, return_inverse=True)
    return table.find(unique)[of]


def _fetched(block: _Block, model: Model) -> _Arcs:
    """A block's arcs, fetched together in the order of their keys rather than one by one."""
    n, width = len(block.numbers), np.uint64(model.width)
    pair, triple = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    logs = [np.zeros(n) for _ in range(4)]
    a, b = block.numbers[:-1], block.numbers[1:]
    at = np.flatnonzero((a >= 0) & (b >= 0) & (block.text[:-1] == block.text[1:])) + 1
    pair[at] = _found(model.pairs, a[at - 1].astype(np.uint64) * width + b[at - 1].astype(np.uint64))
    end = np.flatnonzero((pair[1:] >= 0) & (pair[:-1] >= 0) & (block.text[:-1] == block.text[1:])) + 1  # a kept triple's pairs are kept
    triple[end] = _found(model.triples, pair[end - 1].astype(np.uint64) * width + block.numbers[end].astype(np.uint64))
    for k, (table, places) in enumerate(((model.pairs, pair), (model.triples, triple))):
        there = np.flatnonzero(places >= 0)
        if len(there):
            logs[k][there] = table.take("log10", places[there])
    for k, (table, places) in enumerate(((model.word_weights, block.numbers), (model.pair_weights, pair))):
        there = np.flatnonzero(places >= 0)
        if len(there):
            unique, of = np.unique(places[there], return_inverse=True)
            logs[2 + k][there] = model.weight(table, unique)[of]
    return _Arcs(block.numbers, model.single(block.counts), pair, logs[0], triple, logs[1], logs[2], logs[3])


def traverse(arcs: _Arcs, starts: np.ndarray, lengths: np.ndarray, early: np.ndarray) -> np.ndarray:
    """Log probabilities of stretches ``starts, lengths`` of tokens, all side by side, one token a step; the first ``early`` tokens do not count.

    A stretch's state is empty (0), the word before (1) or the pair before (2).  A token is taken by the arc that its state has for it, or after as many
    failure arcs as it needs, whose weights are added up.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, early = starts[order], lengths[order], early[order]
    state, total = np.zeros(len(order), np.int8), np.zeros(len(order))
    for step in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -step, side="left"))  # stretches that go on
        at, s = starts[:n] + step, state[:n]
        before = np.maximum(at - 1, 0)
        known = arcs.numbers[at] >= 0
        deep = s == 2
        by_triple = deep & (arcs.triple[at] >= 0)
        gain = np.where(by_triple, arcs.triple_log10[at], np.where(deep, arcs.pair_weight[before], 0.0))
        word = (s > 0) & ~by_triple  # in a word's state now, after a failure arc or from the beginning
        by_pair = word & (arcs.pair[at] >= 0)
        gain += np.where(by_pair, arcs.pair_log10[at], np.where(word, arcs.word_weight[before], 0.0))
        taken = by_triple | by_pair
        gain += np.where(taken, 0.0, arcs.singles[at])
        total[:n] += np.where(step >= early[:n], gain, 0.0)
        state[:n] = np.where(taken, 2, known)
    out = np.empty(len(order))
    out[order] = total
    return out


def _stretches(lengths: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths, early tokens and texts of the stretches that texts of ``lengths`` are cut into."""
    pieces = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = nth * STRETCH
    early = np.minimum(begin, back)
    stop = np.minimum(begin + STRETCH, lengths[text])
    first = (np.cumsum(lengths) - lengths)[text]
    return first + begin - early, stop - begin + early, early, text


def scored(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row, by a model of the training rows.

    Tokens are the words of the whole lower-cased (A-Z) text and one end.  A NULL or empty text is the end alone.  Repeated rows
    count and are scored each; a NULL key counts as empty text for the fold.  Other columns are not read.  Without training
    documents all counts are 0.  An empty table gives an empty result.
    """
    coded = blocks(docs, text, key, words=False)
    return scores(coded, fit(coded, settings), settings)


def scores(coded: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """The scores of :func:`scored` for blocks of any corpus."""
    kind = coded.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch, i, model.words)
                arcs = _fetched(block, model)
                starts, lengths, early, text = _stretches(block.lengths, settings.order - 1)
                got = traverse(arcs, starts, lengths, early)
                first, n = np.cumsum(block.lengths) - block.lengths, len(block.lengths)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("ids")[i].values, "held_out": batch.column("held")[i].values, "n_tokens": pa.array(block.lengths),
                    "n_known": pa.array(np.add.reduceat((block.counts > 0).astype(np.int64), first)), "train_tokens": pa.array(np.full(n, model.tokens)),
                    "base_score": pa.array(np.add.reduceat(arcs.singles, first)), "score": pa.array(np.bincount(text, got, n)),
                })

    return coded.mapInArrow(
        trimmed(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
