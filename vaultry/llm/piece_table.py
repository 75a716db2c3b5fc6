"""Ids of the chunks that a worker has met, in arrays: some forty bytes a chunk, so that millions stay known."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from .chunks import halves

_KEYS = ("first-hash-key-0", "other-hash-key-1")


class PieceTable:
    """Chunks by two hashes of 64 bits under different keys, sorted by the first.  Beyond ``limit`` all are forgotten before new ones come.

    A chunk whose first hash another one has is kept by its text.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.first, self.second, self.place = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.apart: dict[str, int] = {}
        self.n, self.size = 0, 0
        self.ids, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    @staticmethod
    def hashes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(pd.util.hash_array(texts, hash_key=k, categorize=False) for k in _KEYS)

    def find(self, texts: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Number of every chunk, -1 for those not known."""
        if not len(texts) or not len(self.first):
            return np.full(len(texts), -1, np.int64)
        first, second = hashes
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        out = np.where((self.first[at] == first) & (self.second[at] == second), self.place[at], -1)
        if self.apart:
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.apart.get(texts[i], -1)
        return out

    def add(self, texts: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], ids: list[list[int]]) -> None:
        """Different chunks that are not known yet, with their ids."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total, new = int(lengths.sum()), len(texts)
        while self.n + new + 1 > len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        while self.size + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.size : self.size + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
        self.starts[self.n : self.n + new + 1] = self.size + np.concatenate(([0], np.cumsum(lengths)))
        numbers = np.arange(self.n, self.n + new)
        self.n, self.size = self.n + new, self.size + total
        order = np.argsort(hashes[0], kind="stable")
        first, second, numbers = hashes[0][order], hashes[1][order], numbers[order]
        at = np.searchsorted(self.first, first)
        taken = np.zeros(new, bool)
        taken[1:] = first[1:] == first[:-1]
        if len(self.first):
            taken |= self.first[np.minimum(at, len(self.first) - 1)] == first
        for i in np.flatnonzero(taken).tolist():
            self.apart[texts[order[i]]] = int(numbers[i])
        free = ~taken
        self.first, self.second, self.place = (
            np.insert(a, at[free], b[free]) for a, b in ((self.first, first), (self.second, second), (self.place, numbers))
        )

    def take(self, index: np.ndarray) -> pa.ListArray:
        starts = self.starts[index]
        lengths = self.starts[index + 1] - starts
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))


def _learn(new: np.ndarray, table: PieceTable, encode_new: Callable[[list[str]], list]) -> None:
    """Adds chunks at first sight; a word that is known without the stop behind it is not encoded again."""
    split = [halves(t) for t in new.tolist()]
    pieces = np.array(list(dict.fromkeys(p for pair in split for p in pair if p)), object)
    hashes = table.hashes(pieces)
    wanted = np.flatnonzero(table.find(pieces, hashes) < 0)
    if len(wanted):
        table.add(pieces[wanted], tuple(h[wanted] for h in hashes), encode_new(pieces[wanted].tolist()))
    place = dict(zip(pieces.tolist(), table.find(pieces, hashes).tolist()))
    whole = np.flatnonzero([bool(b) or not a for a, b in split])
    if len(whole):
        ids, starts = table.ids, table.starts

        def of(piece: str) -> list[int]:
            return ids[starts[place[piece]] : starts[place[piece] + 1]].tolist() if piece else []

        made = [of(a) + of(b) for a, b in (split[i] for i in whole.tolist())]
        table.add(new[whole], tuple(h for h in table.hashes(new[whole])), made)


def resolve(words: pa.Array, table: PieceTable, encode_new: Callable[[list[str]], list]) -> pa.ListArray:
    """Ids of different chunks: looked up at once, and made by ``encode_new`` for the pieces of those at first sight."""
    texts = words.to_numpy(zero_copy_only=False)
    hashes = table.hashes(texts)
    found = table.find(texts, hashes)
    new = np.flatnonzero(found < 0)
    if len(new):
        if table.n + 2 * len(new) > table.limit:
            table.clear()
            new = np.arange(len(texts))
        _learn(texts[new], table, encode_new)
        found = table.find(texts, hashes)
    return table.take(found)
