"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The chunks of all documents are counted; the frequent ones, with their ids, are compiled into an automaton with shared
suffixes (:mod:`.lexicon`), which every Python worker memory-maps.  Chunks outside the lexicon are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .lexicon import Lexicon, compiled
from .shared import highest, put_file, stored, text_slices, texts_of, trimmed, work_folder

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept by a worker beside the lexicon; a bound on memory only.
KNOWN_PIECES = 150_000
#: Text bytes that are encoded at a time.
SLICE = 2 << 20
#: Longer chunks (in characters) are merged one by one with a heap.
LONG = 64
_NONE = 1 << 40


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in vocabulary files of byte-level BPE."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """The vocabulary and the exact merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, symbols = model["model"]["vocab"], byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in model["added_tokens"])]))
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.single = [vocabulary[symbols[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        pairs = sorted((left << 17 | right, rank, made) for (left, right), (rank, made) in self.merges.items())
        self._keys, self._ranks = (np.asarray([p[k] for p in pairs], np.int64) for k in (0, 1))
        self._made = np.zeros(len(pairs), np.int64)
        self._made[self._ranks] = [p[2] for p in pairs]
        self._single = np.asarray(self.single, np.int64)
        self.split = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = chunks.Known(KNOWN_PIECES)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in data]
        if len(ids) < 2:
            return ids
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        merges = self.merges
        queue = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else -1
            if j < 0 or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1], made, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, m[1], ids[h], made))
        return [i for i in ids if i >= 0]

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def pieces(self, data: list[bytes]) -> list[list[int]]:
        """:meth:`piece` of many pre-tokens at once: every round merges the first least pair of each unfinished one."""
        flat = np.frombuffer(b"".join(data), np.uint8)
        ids = self._single[flat]
        piece = np.repeat(np.arange(len(data)), [len(d) for d in data])
        ranks = np.full(len(ids), _NONE, np.int64)
        same = np.flatnonzero(piece[1:] == piece[:-1])
        ranks[same] = self._pair_ranks(ids[same], ids[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(ids))))
            open_ = least < _NONE
            if not open_.all():
                done.append((piece[~open_], ids[~open_]))
                ids, piece, ranks, least = ids[open_], piece[open_], ranks[open_], least[open_]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == least)
            hits = hits[np.concatenate(([True], piece[hits[1:]] != piece[hits[:-1]]))]
            ids[hits] = self._made[ranks[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, piece, ranks = ids[keep], piece[keep], ranks[keep]
            hits = hits - np.arange(len(hits))
            for at in (hits, hits - 1):
                inside = (at >= 0) & (at + 1 < len(ids))
                at, ok = at[inside], piece[at[inside]] == piece[at[inside] + 1]
                ranks[at] = np.where(ok, self._pair_ranks(ids[at], ids[at + 1]), _NONE)
            if hits[-1] == len(ids) - 1:
                ranks[-1] = _NONE
        piece, ids = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(piece, kind="stable")
        flat_ids, ends = ids[order].tolist(), np.cumsum(np.bincount(piece, minlength=len(data))).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]

    def chunks(self, texts: list[str]) -> list[list[int]]:
        """:meth:`chunk` of many different chunks; their pre-tokens are merged together."""
        find, special = self.split.findall, self.special
        parts_of: list[list[str] | None] = []
        for text in texts:
            if len(text) > LONG or "<" in text and any(s in text for s in special):
                parts_of.append(None)
            elif text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                parts_of.append([text])  # a blank and letters need no pattern
            else:
                parts_of.append(find(text))
        new = list(dict.fromkeys(p for parts in parts_of if parts for p in parts))
        ids_of = dict(zip(new, self.pieces([p.encode() for p in new])))
        return [
            self.chunk(text) if parts is None else ids_of[parts[0]] if len(parts) == 1
            else [i for p in parts for i in ids_of[p]]
            for text, parts in zip(texts, parts_of)
        ]

    def chunk(self, text: str) -> list[int]:
        """Ids of a chunk or of a whole text."""
        if self.cut_special and any(s in text for s in self.special):
            out: list[int] = []
            for part in self.cut_special.split(text):
                out += [self.special[part]] if part in self.special else self._ordinary(part)
            return out
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split.findall(text):
            out += self.piece(part.encode())
        return out


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


@functools.lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon.mapped(SparkFiles.get(name))


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> pa.Array:
    return pa.array(merger(path).bytes_of, pa.binary())


def lookup(words: pa.Array, lexicon: Lexicon, merges: Merger) -> pa.ListArray:
    """Ids of different chunks: by the automaton, outside of it by merging."""
    bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    ranks = lexicon.ranks(data, bounds[:-1], np.diff(bounds))
    inside, outside = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
    merged = chunks.resolve(words.take(pa.array(outside)), merges.known, merges.chunks)
    both = pa.concat_arrays([lexicon.lists(ranks[inside]), merged])
    order = np.empty(len(ranks), np.int64)
    order[np.concatenate((inside, outside))] = np.arange(len(ranks))
    return both.take(pa.array(order))


def chunk_counts(docs: DataFrame, text: str = "text", max_bytes: int = 32, held: int = 300_000) -> DataFrame:
    """``chunk, n``: how often every chunk of up to ``max_bytes`` occurs in all documents.

    A task adds up as many as ``held`` chunks before it hands them on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            for part in text_slices(batch, text):
                words, codes, _ = chunks.different(texts_of(part, text))
                numbers = np.bincount(codes, minlength=len(words))
                keep = (numbers > 0) & (np.asarray(pc.binary_length(words)) <= max_bytes)
                for word, n in zip(words.filter(pa.array(keep)).to_numpy(zero_copy_only=False).tolist(), numbers[keep].tolist()):
                    sums[word] = sums.get(word, 0) + n
                if len(sums) >= held:
                    yield pa.RecordBatch.from_pydict({"chunk": list(sums), "n": list(sums.values())})
                    sums = {}
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": list(sums), "n": list(sums.values())})

    counted = docs.select(text).mapInArrow(trimmed(count), "chunk string, n long")
    return counted.where("chunk <> ''").groupBy("chunk").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, tokenizer: str, text: str = "text", max_words: int = 120_000, min_count: int = 2) -> str:
    """Compile the lexicon of the most frequent chunks of all documents and hand it to the executors.

    ``max_words`` bounds the lexicon (some megabytes) and so the driver's part; every other chunk is merged exactly where it
    occurs.  Returns the name of the file, which each executor fetches once from the shared folder.
    """
    spark = docs.sparkSession
    top = highest(stored(chunk_counts(docs, text).where(F.col("n") >= min_count), "chunk-counts"), "n", max_words)
    merges = merger(tokenizer)
    words = [r.chunk for r in top.select("chunk").collect()]
    entries = dict(zip([w.encode() for w in words], merges.chunks(words)))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    uri = f"{work_folder(spark, 'lexicon')}/{name}"
    put_file(spark, uri, compiled(entries))
    spark.sparkContext.addFile(uri)
    return name


def encode(
    docs: DataFrame, tokenizer: str, lexicon: str | None = None, text: str = "text", ids: bool = True, keep_text: bool = True
) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``ids`` (if asked for), ``ids_sha256`` and ``decoded_sha256``.

    Ids equal those of the tokenizers library for the same file without special tokens added; a special token's string in a
    text becomes its id.  ``decoded_sha256`` is of the text that the ids decode to.  A NULL or empty text has no ids and
    decodes to the empty text.  Repeated rows are encoded each; the text is dropped without ``keep_text``; other columns are kept, unless one has the name of a result
    column, which replaces it.  An empty table gives an empty result.
    """
    name = lexicon or fit(docs, tokenizer, text)
    made = ["n_tokens", *(["ids"] if ids else []), "ids_sha256", "decoded_sha256"]
    kept = [c for c in docs.columns if c not in made and c != text]
    # other columns travel as one struct, whatever their names and types
    packed = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text")) if kept else docs.select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, merges, tokens = _lexicon(name), merger(tokenizer), _token_bytes(tokenizer)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                flat, bounds = chunks.encode(texts_of(part), lambda w: lookup(w, automaton, merges))
                decoded = decode(flat, bounds, tokens)
                raw = flat.astype("<u4").tobytes()
                at = (bounds * 4).tolist()
                out = {"row": part.column("row")} if kept else {}
                if keep_text:
                    out["text"] = part.column("text")
                out["n_tokens"] = pa.array(np.diff(bounds))
                if ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
                out["ids_sha256"] = pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(out)
        merges.known.clear()  # the worker may go on to other work

    schema = (f"row {packed.schema['row'].dataType.simpleString()}, " if kept else "") + ("text string, " if keep_text else "") + "n_tokens long, "
    schema += ("ids array<int>, " if ids else "") + "ids_sha256 string, decoded_sha256 string"
    result = packed.mapInArrow(trimmed(run), schema)
    return result.select(*([F.col("row")[c].alias(c) for c in kept]), *([F.col("text").alias(text)] if keep_text else []), *made)


def decode(ids: np.ndarray, bounds: np.ndarray, tokens: pa.Array) -> list[bytes]:
    """UTF-8 of the texts whose ids lie between consecutive ``bounds``; broken UTF-8 becomes U+FFFD."""
    joined = tokens.take(pa.array(ids))
    if not len(joined):
        return [b""] * (len(bounds) - 1)
    at = np.frombuffer(joined.buffers()[1], np.int32)[bounds].tolist()
    data = joined.buffers()[2].to_pybytes()
    return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:])]
