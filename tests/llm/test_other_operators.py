"""Archives, vectors, components and the pipeline."""

import hashlib

import numpy as np
from llm_tables import SCHEMA, documents
from pyspark.sql import functions as F

import corpus_pipeline
from vaultry.llm import neighbours, warc
from vaultry.llm.components import components

PAGES = "page_id long, url string, html string, note string"


def test_warc_round_trip(spark):
    big, other = "<p>" + "é" * 600, "y" * 999
    rows = [(1, "http://a/1", big, None), (7, "http://a/7", big, "x"), (3, None, big, None), (2, "http://b", None, None), (4, "u\r\nv", "", None),
            (5, "http://c", other, None), (6, "http://c", other, None), (None, "http://d", big, None), (7, "http://a/7", big, None),
            (8, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 400, None)]
    rows += [(100 + i, f"http://n/{i}", f"<html><body>page {i} " + "common words in every page " * 20, None) for i in range(60)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(3), archive_bytes=2000)
    assert manifest.count() > 3  # archives are closed when full
    got = warc.read(manifest).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("n_records")).first()[0]
    for r in got:
        html = next(h or "" for k, _, h, _ in rows if k == r.page_id)
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = html == big and r.page_id != 7
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
        assert r.payload == (None if revisit else html)
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


def test_warc_dictionary_leads_each_archive(spark):
    rows = [(i, "u", f"<html><head><title>title {i}</title></head><body>" + f"paragraph {i * i} of the page. " * 30, None) for i in range(300)]
    pages = spark.createDataFrame(rows, PAGES)
    assert warc.trained_dictionary(pages)
    for r in warc.write(pages).collect():
        with open(r.archive.removeprefix("file:"), "rb") as file:
            assert int.from_bytes(file.read(4), "little") == warc.DICTIONARY_MAGIC


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, i) for i in range(501, 700)] + [(9, 9), (None, 3), (7, None)]
    edges += [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(200)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    found = {}
    for k, v, *_ in rows:
        good = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        found[k] = np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64)) if good else None
    keys = sorted(found)
    links = {k: set() for k in keys}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if found[a] is not None and found[b] is not None and len(found[a]) == len(found[b]) and found[a] @ found[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    least = {k: k for k in keys}
    for _ in keys:
        for k in keys:
            for o in links[k]:
                least[k] = min(least[k], least[o])
    return {k: (len(links[k]), least[k]) for k in keys}


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    f = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f(rng.standard_normal(16)), 0) for i in range(200)]
    centre = rng.standard_normal(16)
    rows += [(300 + i, f(centre + 0.05 * rng.standard_normal(16)), i % 3) for i in range(60)]  # a tight group
    spread = rng.standard_normal(16)
    rows += [(400 + i, f(spread + 0.28 * rng.standard_normal(16)), 1) for i in range(80)]  # pairs around the threshold
    rows += [(500 + i, f(rows[5][1]), 2) for i in range(20)]  # equal vectors
    rows += [(600 + i, f(np.asarray(rows[i][1]) * 3 + 0.2 * rng.standard_normal(16)), 2) for i in range(20)]
    rows += [(700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] + [1.0] * 15, 1), (703, [None] + [1.0] * 15, 1),
             (704, [float("inf")] * 16, 1), (705, [], 1), (706, [1.0, 2.0], 1), (707, [1.0, 2.0], 1), (708, [1e30] * 16, 1), (709, [1e-30] * 16, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    assert all(got[k][0] <= expected[k][0] for k in got)  # no link below the threshold
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in expected.values())
    tight = [k for k in got if not 400 <= k < 500]
    assert all(got[k] == expected[k] for k in tight)


def test_neighbours_beyond_full_lists(spark):
    """Leaders whose lists are still full when these stop growing have all their links."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(48)
    centre /= np.linalg.norm(centre)
    rows = []
    for i in range(150):  # all pairs at cosines of about 0.94: every vector leads itself
        v = rng.standard_normal(48)
        v -= (v @ centre) * centre
        rows.append((i, [float(np.float32(x)) for x in centre + 0.25 * v / np.linalg.norm(v)], 0))
    settings = neighbours.Settings(neighbours=4, most_rounds=2, query_rows=40)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS), settings).collect()}
    assert got == brute(rows)


def test_neighbours_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 0), (None, None, None), (2, [0.0, 1.0], 0)]
    got = sorted(map(tuple, neighbours.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    named = [r for r in got if r[0] is not None]
    assert named == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)] * 2
    assert neighbours.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_pipeline(spark, odd, none):
    long_text = [" ".join(f"w{(i * 37 + k * k * (i + 3)) % 4001}" for k in range(60)) for i in range(30)]
    docs = documents(spark, [*long_text, long_text[0], long_text[1] + " end", "too short"])
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns and kept.schema["text"].dataType == SCHEMA["text"].dataType
        if name == "quality rules":
            assert kept.count() == 32
        if name == "near duplicates":
            ids = {r.doc_id for r in kept.collect()}
            assert set(range(30)) <= ids and 30 not in ids
    assert {r.doc_id for r in kept.collect()} <= ids and kept.count() > 0
    clashing = odd.withColumns({c: F.lit(1) for c in ("n_words", "kept", "row", "_row", "fp", "ids", "size", "_found", "hash")})
    for table in (odd, none, clashing):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, "")
        table.count()
