"""Hard negatives against brute force, and the intervals against exact products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultry.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, _row string"
SMALL = hn.Settings(row_block=64, anchor_block=3, chunk=50, score_pairs=7)


def brute(rows, k=5, m=3):
    """Every pair scored in integers."""
    seen = {}
    for i, e, label in sorted(((r[0], r[1], r[2]) for r in rows if r[0] is not None), key=lambda r: (r[0], r[2] is None, r[2] or 0)):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        if all(abs(x) <= hn.MOST for x in v):
            seen.setdefault(i, (label, v))
    out = []
    for a, (la, va) in seen.items():
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in seen.items() if i != a and len(v) == len(va)]
        scores.sort(key=lambda s: s[:2])
        for p, i, _ in [s for s in scores if s[2] == la][:k]:
            fit = [(s, j) for s, j, label in scores if label != la and 50 * -p <= 100 * -s <= 95 * -p][:m]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, settings=SMALL):
    df = spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)
    got = hn.mine(df, F.col("vec_id") % 50 == 0, settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_exact_products(dim):
    rng = np.random.default_rng(dim)
    v = rng.integers(-300, 300, (200, dim))
    v[:3], v[3] = 0, 1
    bits, aligned, rest = hn.coded(v, SMALL)
    rows = hn.Rows(np.arange(200), np.zeros(200, np.int64), v, bits, aligned, rest)
    low, high = hn.Anchors(np.arange(9), np.zeros(9, np.int64), v[:9], SMALL).interval(rows)
    exact = v[:9] @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    width = (high - low)[4:, 4:] / np.sqrt((v[4:9] ** 2).sum(1))[:, None] / np.sqrt((v[4:] ** 2).sum(1))
    assert width.mean() < 0.4  # close enough to leave most out


def test_search_leaves_most_pairs_out():
    rng = np.random.default_rng(3)
    v = rng.integers(-60, 60, (4000, 64))
    settings = hn.Settings()
    rows = hn.Rows(np.arange(4000), rng.integers(0, 10, 4000), v, *hn.coded(v, settings))
    anchors = hn.Anchors(np.arange(20), rows.labels[:20], v[:20], settings)
    asked = []
    plain = anchors.scores
    anchors.scores = lambda part, a, r: (asked.append(len(a)), plain(part, a, r))[1]
    hn.nearest_alike(anchors, rows, settings)
    assert sum(asked) < 0.05 * 20 * 4000


def test_query_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(700):
        e = rng.standard_normal(64).astype(np.float32) / 8
        rows.append((i, [float(x) for x in e], int(rng.integers(0, 3))))
    for i in range(40):  # copies of anchors under other labels, near copies, ties
        base = np.asarray(rows[50 * (i % 9)][1])
        rows.append((1000 + i, [float(x) for x in base * (0.7 if i % 2 else 1)], i % 4))
        rows.append((2000 + i, [float(x) for x in base * 0.7 + rng.standard_normal(64) / 20], i % 4))
    rows += [(3000 + i, rows[7][1], 2) for i in range(30)]  # one label holds many equal rows
    bad = [float("nan"), None, float("inf")]
    rows += [(4000 + i, [0.1] * 63 + [x], 1) for i, x in enumerate(bad)] + [(4050, None, 1), (4100, [0.5] * 64, None), (None, [0.5] * 64, 1)]
    rows += [(50, rows[50][1], rows[50][2])] + [(5, rows[5][1], rows[5][2])] * 2 + [(5000 + i, [0.0] * 64, i % 2) for i in range(8)]
    rows += [(6000 + 25 * i, [0.3 * i, 0.2, -0.1], i % 2) for i in range(14)] + [(7000 + 25 * i, [], i % 2) for i in range(6)]
    rows += [(8000, [1e30] + [0.0] * 63, 1), (8050, [2e5, 0.0], 0), (8051, [2e5, 1.0], 0), (8052, [1.5e5, 1.0], 1)]
    want = brute(rows)
    assert mined(spark, rows) == want
    assert {8050, 7000, 6050} <= {r[0] for r in want}


def test_hot_label_and_empty_table(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 0 if i % 3 else i % 5) for i in range(400)]
    assert mined(spark, rows, hn.Settings()) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
