"""A minimal acyclic transducer from words to numbers, as arrays that can be memory-mapped.

States that accept the same suffixes are one state.  Every arc carries the number of words that leave its state by
smaller bytes (plus one if the state itself accepts); the sum along a word is its rank in byte order, and the rank points to
its token ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MAGIC = np.int64(0x4C455831)


def _minimal(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Arcs and acceptance by state of the minimal automaton of ``words`` (sorted, different); state 0 starts.

    Sorted words leave everything but the path of the last word final, so a state is compared with the register of known
    states as soon as the next word turns away from it.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    free: list[int] = []
    path = [0]
    last = b""

    def settle(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            state = path.pop()
            form = (final[state], tuple(arcs[state].items()))
            known = register.setdefault(form, state)
            if known != state:
                arcs[path[-1]][last[i - 1]] = known
                free.append(state)

    for word in words:
        shared = 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        settle(shared)
        for byte in word[shared:]:
            if free:
                state = free.pop()
                arcs[state], final[state] = {}, False
            else:
                state = len(arcs)
                arcs.append({})
                final.append(False)
            arcs[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = word
    settle(0)
    return arcs, final


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The lexicon of ``entries`` (non-empty words with their ids) as one block of bytes."""
    words = sorted(entries)
    arcs, final = _minimal(words)
    below = [-1] * len(arcs)
    stack = [0]
    while stack:  # words below a state, children first
        state = stack[-1]
        missing = [t for t in arcs[state].values() if below[t] < 0]
        if missing:
            stack.extend(missing)
        else:
            below[state] = int(final[state]) + sum(below[t] for t in arcs[state].values())
            stack.pop()
    keys, targets, adds = [], [], []
    for state, out in enumerate(arcs):
        if below[state] < 0:
            continue  # merged away
        rank = int(final[state])
        for byte in sorted(out):
            keys.append(state << 8 | byte)
            targets.append(out[byte])
            adds.append(rank)
            rank += below[out[byte]]
    starts = np.cumsum([0, *(len(entries[w]) for w in words)])
    ids = [i for w in words for i in entries[w]]
    parts = [
        np.asarray(keys, np.int64), np.asarray(starts, np.int64), np.asarray(targets, np.int32),
        np.asarray(adds, np.int32), np.asarray(ids, np.int32), np.asarray(final, np.uint8),
    ]
    head = np.asarray([_MAGIC, *(len(p) for p in parts)], np.int64)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """A compiled lexicon over a memory-mapped file or bytes."""

    def __init__(self, data: np.ndarray):
        head = data[:56].view(np.int64)
        if head[0] != _MAGIC:
            raise ValueError("not a lexicon")
        at = 56
        parts = []
        for length, kind in zip(head[1:].tolist(), (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)):
            stop = at + length * np.dtype(kind).itemsize
            parts.append(data[at:stop].view(kind))
            at = stop
        self.keys, self.starts, self.targets, self.adds, self.ids, self.final = parts

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    @classmethod
    def of(cls, data: bytes) -> Lexicon:
        return cls(np.frombuffer(data, np.uint8))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def ranks(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rank of every word ``data[start : start + length]``, -1 for those outside; all walk in step."""
        rank = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int64)
        live = np.arange(len(starts)) if len(self.keys) else np.zeros(0, np.int64)
        known = np.zeros(len(starts), bool)
        step = 0
        while len(live):
            ended = lengths[live] == step
            done = live[ended]
            known[done] = self.final[state[done]] == 1
            live = live[~ended]
            if not len(live):
                break
            key = state[live] << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            rank[live] += self.adds[at]
            state[live] = self.targets[at]
            step += 1
        return np.where(known, rank, -1)

    def lists(self, ranks: np.ndarray) -> pa.ListArray:
        """Ids of the words of these ranks."""
        starts = self.starts[ranks]
        lengths = self.starts[ranks + 1] - starts
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
