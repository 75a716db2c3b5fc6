"""Periodic runs against brute force over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_tables import PROSE, SCHEMA, documents
from pyspark.sql import functions as F

from vaultry.llm import periods, registry


def brute(words):
    """All runs of a sequence, by trying every period from every place."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            part = words[s:e]
            smallest = next(p for p in range(1, q + 1) if part[:-p] == part[p:])
            if e - s >= max(6, 4 * q) and smallest == q:
                found.append((s, e - s, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def of(words):
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    s, n, q = periods.runs(np.array([code[w] for w in words], np.int64))
    return list(zip(s.tolist(), n.tolist(), q.tolist()))


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for size in (2, 8, 64):
        a, b = rng.integers(0, periods.PRIME, (2, 3, size), dtype=np.uint64)
        got = periods.inverse(periods._product(periods.transform(a), periods.transform(b)))
        for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
            want = [sum(x[i] * y[(k - i) % size] for i in range(size)) % periods.PRIME for k in range(size)]
            assert z == want


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_equal_brute_force(letters):
    rng = np.random.default_rng(letters)
    for trial in range(60):
        words = [str(x) for x in rng.integers(0, letters, rng.integers(0, 160))]
        for _ in range(rng.integers(0, 4)):
            piece = [str(x) for x in rng.integers(0, letters, rng.integers(1, 20))]
            times, at = int(rng.integers(2, 9)), int(rng.integers(0, len(words) + 1))
            words[at:at] = (piece * times)[: len(piece) * times - int(rng.integers(0, len(piece)))]
        assert of(words) == brute(words), (letters, trial, words)


def test_nested_and_long_periods():
    inner = ["a"] * 100 + ["b"]
    words = (inner * 7)[:-3]
    assert of(words) == brute(words)
    rng = np.random.default_rng(7)
    unit = [f"w{x}" for x in rng.integers(0, 5000, 1777)]
    long = [f"u{i}" for i in range(913)] + unit * 5 + unit[:100] + [f"v{i}" for i in range(50)]
    assert (913, 5 * 1777 + 100, 1777) in of(long)
    assert of(["x"] * 30_000) == [(0, 30_000, 1)]
    assert of(["x"] * 5) == [] and of(["x"] * 6) == [(0, 6, 1)] and of(["x", "y"] * 3) == [] and of(["x", "y"] * 4) == [(0, 8, 2)]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_brute_force(spark, odd, none):
    texts = [PROSE, "go " * 9, "a b\nc " * 5 + "a b", "x y x y x y x y z " * 6, None, "", " \n "] + [" ".join(f"t{i * i % 61}" for i in range(200))] * 3
    docs = documents(spark, texts * 12).unionByName(odd).withColumn("runs", F.lit(1)).withColumn("_text", F.lit("clash"))
    docs = docs.where("text IS NULL OR length(text) < 20000")
    rows = docs.select("doc_id", "text").collect()
    got = periods.digest(periods.detect(periods.with_planted_periods(docs))).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        found = brute(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs for r in got) > 20
    assert periods.digest(periods.detect(periods.with_planted_periods(none))).count() == 0


def test_long_text(spark, odd):
    long = odd.where("length(text) > 100000")
    row = periods.detect(long).first()
    assert row.n_words == 40_000
    words = [f"p{i % 4999}" for i in range(60_000)]
    row = periods.detect(spark.createDataFrame([(1, " ".join(words), None, None, None)], SCHEMA)).first()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 4999)]
    assert row.collapsed == " ".join(words[:4999])


def test_registered(spark):
    df = registry.QUERIES["op12_block_convolution_runs"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert df.where("n_runs > 0").count() > 0
