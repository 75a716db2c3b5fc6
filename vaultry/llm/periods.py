"""Periodic runs of words by block convolution.

At the scale ``L`` = 1, 2, 4, ... the words are cut into blocks of ``L``.  A block's squared differences from every place at a distance
of ``L`` to ``2L - 1`` are sums of squares less a correlation, which a number-theoretic transform gives in exact integers
modulo a prime.  A zero is an occurrence, its distance a period to try: a run of period ``q`` in ``[L, 2L)`` and of four periods
or more holds a whole block together with that occurrence, so no run is missed.  Occurrences are extended to both sides
as far as words ``q`` apart agree.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_slices, texts_of, trimmed, words_of

#: A prime of the form k * 2^23 + 1 and a generator of its roots of unity; two primes and bases of prefix sums.
PRIME, ROOT = 998244353, 3
_SUMS = ((2147483647, 1103515245), (2147483629, 134775813))
#: A run's least length in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Numbers in a transform's matrix at a time; a bound on memory only.
MATRIX = 1 << 18
_P = np.uint64(PRIME)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = a * b
    c -= (c // _P) * _P
    return c


@functools.lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of order ``size``, half of them."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate((out, _product(out, np.uint64(pow(root, len(out), PRIME)))))
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row (a power of two long); the result stands in bit-reversed order."""
    n, size = rows.shape
    half = size // 2
    while half:
        pairs = rows.reshape(n, -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        total, gap = a + b, a - b
        out = np.empty_like(pairs)
        # of a number and itself less (plus) the prime the one that did not wrap round is the smaller
        out[:, :, 0] = np.minimum(total, total - _P)
        out[:, :, 1] = _product(np.minimum(gap, gap + _P), _roots(2 * half, False))
        rows, half = out.reshape(n, size), half // 2
    return rows


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows that :func:`transform` took."""
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, -1, 2, half)
        a, b = pairs[:, :, 0], _product(pairs[:, :, 1], _roots(2 * half, True))
        total, gap = a + b, a - b
        out = np.empty_like(pairs)
        out[:, :, 0] = np.minimum(total, total - _P)
        out[:, :, 1] = np.minimum(gap, gap + _P)
        rows, half = out.reshape(n, size), half * 2
    return _product(rows, np.uint64(pow(size, PRIME - 2, PRIME)))


def occurrences(codes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances in ``[size, 2 size)`` at which the block of ``size`` codes stands again.

    ``codes`` goes on for ``3 size`` beyond the last start.  A sum of squares that is a multiple of the prime is taken for a zero: such
    a place falls when it is extended.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    group = max(MATRIX // (2 * size), 1)
    for at in range(0, len(starts), group):
        first = starts[at : at + group]
        block = codes[first[:, None] + np.arange(size)].astype(np.uint64) % _P
        window = codes[first[:, None] + np.arange(size, 3 * size)].astype(np.uint64) % _P
        turned = np.zeros((len(first), 2 * size), np.uint64)
        turned[:, 0] = block[:, 0]
        turned[:, 2 * size - np.arange(1, size)] = block[:, 1:]
        correlation = inverse(_product(transform(turned), transform(window)))[:, :size]
        squares = np.cumsum(_product(window, window), axis=1)  # far below 2^64
        inside = squares[:, size - 1 : 2 * size - 1].copy()
        inside[:, 1:] -= squares[:, : size - 1]
        own = _product(block, block).sum(axis=1)
        row, shift = np.nonzero((own[:, None] + inside + 2 * (_P - correlation)) % _P == 0)
        found.append((first[row], size + shift))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


class _Prefixes:
    """Sums over prefixes, weighted with powers, for comparing stretches at once; equality is confirmed word by word later."""

    def __init__(self, codes: np.ndarray):
        self.tables = []
        for prime, base in _SUMS:
            p, powers = np.uint64(prime), np.ones(1, np.uint64)
            while len(powers) <= len(codes):
                powers = np.concatenate((powers, powers * np.uint64(pow(base, len(powers), prime)) % p))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)] % p) % p))
            self.tables.append((p, powers, sums))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(len(i), bool)
        for p, powers, sums in self.tables:
            left = (sums[i + length] + p - sums[i]) % p * powers[j - i] % p
            same &= left == (sums[j + length] + p - sums[j]) % p
        return same


def _most(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """The largest number of ``[low, high]`` for which ``holds``, by halving; it holds at ``low``."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        ok = holds(middle)
        low = np.where(open_ & ok, middle, low)
        high = np.where(open_ & ~ok, middle - 1, high)
    return low


def _agreeing(codes: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """First and last place around ``start`` up to which codes ``period`` apart agree, one by one."""
    left, right = start, start
    while left > 0 and codes[left - 1] == codes[left - 1 + period]:
        left -= 1
    while right + period < len(codes) and codes[right] == codes[right + period]:
        right += 1
    return left, right + period


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods, by start and period, of all runs in ``codes`` (0 or more).

    A code that occurs once ends every run, so several texts can be laid side by side with such codes between them.
    """
    n = len(codes)
    none = np.zeros(0, np.int64)
    if n < LEAST_WORDS:
        return none, none, none
    order = np.argsort(codes, kind="stable")
    reach = np.full(n, n, np.int64)  # distance to the next place of the same code
    again = codes[order[1:]] == codes[order[:-1]]
    reach[order[:-1][again]] = (order[1:] - order[:-1])[again]
    padded = np.concatenate((codes, np.full(3 * n, codes.max() + 1, codes.dtype)))
    prefixes = None
    start, stop, period = none, none, none
    size = 1
    while LEAST_PERIODS * size <= n:
        # a block with a word that does not come again within the window has no occurrence there
        blocks = np.flatnonzero(reach < 2 * size) * size
        covered = np.zeros(0, np.int64)
        if len(start):
            by_start = np.argsort(start, kind="stable")
            starts_, ends_ = start[by_start], np.maximum.accumulate(stop[by_start])

            def covered_to(place: np.ndarray) -> np.ndarray:
                at = np.searchsorted(starts_, place, side="right") - 1
                return np.where(at >= 0, ends_[np.maximum(at, 0)], -1)

            # inside a run of a shorter period every distance is a multiple of that period, and nothing new
            blocks = blocks[covered_to(blocks) < blocks + 3 * size - 1]
        b, q = occurrences(padded, blocks, size)
        keep = b + q + size <= n
        if len(start):
            keep &= covered_to(b) < b + q + size
        b, q = b[keep], q[keep]
        if len(b):
            prefixes = prefixes or _Prefixes(codes)
            true = prefixes.equal(b, b + q, np.full(len(b), size))
            b, q = b[true], q[true]
            right = _most(np.full(len(b), size), n - b - q, lambda k: prefixes.equal(b, b + q, k))
            left = _most(np.zeros(len(b), np.int64), b, lambda k: prefixes.equal(b - k, b - k + q, k))
            s, e = b - left, b + q + right
            long = e - s >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            b, q, s, e = b[long], q[long], s[long], e[long]
            # of one stretch the shortest period counts, and one occurrence is enough
            first = np.lexsort((q, e, s))
            b, q, s, e = b[first], q[first], s[first], e[first]
            new = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[: len(s)]
            made = []
            for b_, q_, s_, e_ in zip(b[new].tolist(), q[new].tolist(), s[new].tolist(), e[new].tolist()):
                if not np.array_equal(codes[s_ : e_ - q_], codes[s_ + q_ : e_]):  # equal sums of different stretches
                    s_, e_ = _agreeing(codes, b_, q_)
                if e_ - s_ >= max(LEAST_WORDS, LEAST_PERIODS * q_):
                    made.append((s_, e_, q_))
            if made:
                s, e, q = np.array(made, np.int64).T
                start, stop, period = np.concatenate((start, s)), np.concatenate((stop, e)), np.concatenate((period, q))
        size *= 2
        half = len(reach) // 2
        reach = np.maximum(reach[0 : 2 * half : 2], reach[1 : 2 * half : 2])
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.concatenate(([True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])))[: len(start)]
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (stop - start)[order], period[order]


def _judged(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of every text."""
    words, counts = words_of(texts)
    n, bounds = len(texts), np.concatenate(([0], np.cumsum(counts)))
    inner = words.dictionary_encode()
    codes = np.empty(len(words) + n, np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(1, n + 1), counts)
    codes[place] = np.asarray(inner.indices)
    gaps = bounds[:-1] + np.arange(n)  # a code of its own before each text
    codes[gaps] = len(inner.dictionary) + np.arange(n)
    start, length, period = runs(codes)
    text = np.searchsorted(gaps, start, side="right") - 1
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step)[place] == 0
    ends = np.concatenate(([0], np.cumsum(kept)))[bounds].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), words.filter(pa.array(kept))), " ")
    rows = pa.StructArray.from_arrays(
        [pa.array(start - gaps[text] - 1), pa.array(length), pa.array(period)], ["start", "length", "period"]
    )
    at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).astype(np.int32)
    return pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), rows), collapsed


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, runs array<struct<start, length, period>>, collapsed`` of every row.

    A run is a longest stretch of words whose smallest period is ``period``, of ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods or more;
    words count from 0.  ``collapsed`` has the words, joined by blanks, that no run holds behind its first period.
    NULL and empty texts have no words, no runs and an empty ``collapsed``.  Rows are judged each for itself: repeated rows and NULL keys
    are kept as they are.  Other columns are not read, whatever their names.  One text is one task's work, of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                n_words, found, collapsed = _judged(texts_of(part, "_text"))
                yield pa.RecordBatch.from_pydict({"_key": part.column("_key"), "n_words": n_words, "runs": found, "collapsed": collapsed})

    kind = docs.schema[key].dataType.simpleString()
    fields = f"_key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(trimmed(run), fields)
    return rows.withColumnRenamed("_key", key)


def strongest(runs: Column) -> Column:
    """The run of greatest length by period as ``struct<exponent, start, period, length>``; ties go to the smallest start, then period.

    ``start`` and ``period`` are negated, so that the largest struct is the one.  The quotient tells lengths apart up to 2^26 words.
    """
    return F.array_max(F.transform(runs, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")
    )))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for every row of :func:`detect`: the strongest run, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("*", strongest(F.col("runs")).alias("best"))
    return best.select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text`` with the words of about every tenth text made periodic from some word on, by the crc32 of its key.

    With ``h`` the crc, ``g = h / 10`` and ``n`` words, where ``h`` is divisible by 10 each word ``i >= a = g % n`` becomes word
    ``a + (i - a) % p``, ``p = 1 + (n - a) / (3 + g % 8)`` (whole quotients).  Other texts, and those with a NULL key, stay.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    hashed = docs.select(F.col(key), F.col(text).alias("_text"), h.alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    cut = hashed.select(key, "_text", F.floor(F.col("_h") / 10).alias("_g"), words.alias("_w"))
    n = F.size("_w")
    placed = cut.select(key, "_text", "_w", "_g", F.when(n > 0, F.col("_g") % n).alias("_a"))
    period = F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)) + 1
    sized = placed.select(key, "_text", "_w", "_a", period.alias("_p"))
    again = F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(
        F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))
    ))
    return sized.select(key, F.when(n > 0, F.array_join(again, " ")).otherwise(F.col("_text")).alias(text))
