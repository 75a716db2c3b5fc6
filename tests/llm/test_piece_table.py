"""The table of chunks against a plain dictionary."""

import zlib

import numpy as np
import pyarrow as pa

from vaultry.llm import piece_table


def encoded(pieces):
    return [[len(p), *map(ord, p)] for p in pieces]


def test_lookup_forgets_and_keeps_equal_hashes_apart(monkeypatch):
    rng = np.random.default_rng(2)
    table = piece_table.PieceTable(60)
    for round_ in range(30):
        if round_ == 15:  # from here on many chunks share their first hash
            monkeypatch.setattr(piece_table.PieceTable, "hashes", staticmethod(lambda t: (np.array([len(x) for x in t], np.uint64), np.array([zlib.crc32(x.encode()) for x in t], np.uint64))))
            table.clear()
        words = list(dict.fromkeys(" " * int(rng.integers(0, 2)) + "ab"[: rng.integers(0, 3)] + str(rng.integers(0, 9)) * int(rng.integers(0, 2)) + ".,"[: rng.integers(0, 2)] for _ in range(20)))
        got = piece_table.resolve(pa.array(words), table, encoded).to_pylist()
        want = []
        for w in words:
            a, b = piece_table.halves(w)
            want.append((encoded([a])[0] if a else []) + (encoded([b])[0] if b else []))
        assert got == want
    assert piece_table.resolve(pa.array([], pa.string()), table, encoded).to_pylist() == []
