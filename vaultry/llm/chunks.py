"""Byte-level BPE by chunks: pieces of a text that are encoded alike wherever they stand.

The pre-tokenizer never joins what stands before a blank between two other characters with what stands after it, when
neither neighbour is white space.  Texts are therefore cut in front of such blanks, each different chunk
of a batch is encoded once, and the ids are gathered by position.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import plain_offsets

#: Fixed value: the special token of the vocabulary, recognised in texts as the tokenizers library does by default.
SPECIAL = "<|endoftext|>"
#: A blank next to white space (or what some engine takes for it): such texts are cut by ``_CUT``.
_ODD = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}] | [\s\p{Z}\x{85}\x{1c}-\x{1f}]"
_CUT = re.compile(r"(?<=\S) (?=\S)")

class Known:
    """Ids of the pieces met so far.  Beyond ``limit`` all are forgotten before new ones come: a bound on memory only."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at, self.size = {}, 0
        self.ids, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def add(self, pieces: list[str], ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.at), int(lengths.sum())
        while n + len(pieces) + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        while self.size + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.size : self.size + total] = [i for x in ids for i in x]
        self.starts[n] = self.size
        self.starts[n + 1 : n + 1 + len(pieces)] = self.size + np.cumsum(lengths)
        self.size += total
        self.at.update(zip(pieces, range(n, n + len(pieces))))


_STOPS = ".,;:!?"


def halves(chunk: str) -> tuple[str, str]:
    """A chunk as two pieces that are encoded apart: a word and the stop behind it; the second one may be empty."""
    if chunk and chunk[-1] in _STOPS and chunk[1:-1].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
        return chunk[:-1], chunk[-1]
    return chunk, ""


def resolve(words: pa.Array, known: Known, encode_new: Callable[[list[str]], list]) -> pa.ListArray:
    """Ids of different chunks: their pieces' ids are looked up, and made by ``encode_new`` at first sight."""
    texts = words.to_numpy(zero_copy_only=False).tolist()
    split = [halves(t) for t in texts]
    pieces = list(dict.fromkeys(p for pair in split for p in pair))
    new = [p for p in pieces if p not in known.at]
    if len(known.at) + len(new) > known.limit:
        known.clear()
        new = pieces
    known.add(new, encode_new(new))
    at = known.at
    index = np.asarray([at[p] for pair in split for p in pair], np.int64)
    starts = known.starts[index]
    lengths = known.starts[index + 1] - starts
    ends = np.cumsum(lengths)
    flat = known.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
    bounds = np.concatenate(([0], ends[1::2])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def cut(texts: pa.Array) -> pa.ListArray:
    """Chunks of every text, in order: all but the first one of a text begin with a blank."""
    odd = np.asarray(pc.match_substring_regex(texts, _ODD))
    parts = pc.split_pattern(texts, " ")
    if not odd.any():
        return parts
    lists = []
    for text, is_odd in zip(texts, odd.tolist()):
        lists.append(_CUT.split(text.as_py()) if is_odd else None)
    # the odd texts' lists take the place of the split ones
    regular = pc.if_else(pa.array(odd), pa.scalar(None, parts.type), parts)
    return pc.coalesce(pa.array(lists, parts.type), regular)


def different(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different chunks (blank included), the code of every chunk in order, and the texts' bounds in it."""
    parts = cut(texts)
    bounds = plain_offsets(parts)
    flat = parts.flatten()
    inner = flat.dictionary_encode()
    codes = np.asarray(inner.indices, dtype=np.int64)
    firsts = flat.take(pa.array(bounds[:-1])).dictionary_encode()
    codes[bounds[:-1]] = len(inner.dictionary) + np.asarray(firsts.indices, dtype=np.int64)
    spaced = pc.binary_join_element_wise(pa.scalar(""), inner.dictionary, " ")
    return pa.concat_arrays([spaced, firsts.dictionary]), codes, bounds


def encode(texts: pa.Array, ids_of: Callable[[pa.Array], pa.ListArray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and the texts' bounds in them.  ``ids_of`` encodes different chunks."""
    if not len(texts):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    chunks, codes, bounds = different(texts)
    # only chunks that occur are encoded: a first chunk has left its code without blank
    used = np.flatnonzero(np.bincount(codes, minlength=len(chunks)))
    place = np.zeros(len(chunks), np.int64)
    place[used] = np.arange(len(used))
    gathered = ids_of(chunks.take(pa.array(used))).take(pa.array(place[codes]))
    return np.asarray(gathered.flatten(), dtype=np.int32), plain_offsets(gathered)[bounds]
