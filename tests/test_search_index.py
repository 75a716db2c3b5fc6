"""Versions of a folder, and the stored index against a count over all texts."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vaultry.operators import retrieval, search_index
from vaultry.sinks import commits


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert commits.current(spark, folder) == (0, {})
    commits.publish(spark, folder, 1, {"a": "é"})
    with pytest.raises(commits.Conflict):
        commits.publish(spark, folder, 1, {"a": "other"})
    assert commits.current(spark, folder) == (1, {"a": "é"})
    assert not [p for p in (tmp_path / "v" / "_versions").iterdir() if "partial" in p.name]


def test_once_is_done_once_and_repeats_after_a_conflict(spark, tmp_path):
    folder, seen = str(tmp_path / "v"), []

    def write(before):
        seen.append(before.get("n", 0))
        if len(seen) == 1:  # another writer is faster
            commits.publish(spark, folder, 1, {"n": 10})
        return {"n": before.get("n", 0) + 1}

    assert commits.once(spark, folder, "op", write) == 2
    assert seen == [0, 10] and commits.current(spark, folder)[1]["n"] == 11
    assert commits.once(spark, folder, "op", write) == 2 and len(seen) == 2
    assert commits.at(spark, folder, 1) == {"n": 10}


def bm25(texts, question):
    tokens = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in texts.items()}
    n, average = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for term in set(re.findall(r"[^\W_]+", question.lower())):
        df = sum(term in t for t in tokens.values())
        for k, t in tokens.items():
            tf = t.count(term)
            if tf:
                norm = tf + 1.2 * (0.25 + 0.75 * len(t) / average)
                out[k] = out.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / norm
    return sorted(((k, round(s, 6)) for k, s in out.items()), key=lambda x: (-x[1], x[0]))


def test_index_follows_changes(spark, tmp_path):
    folder = str(tmp_path / "index")
    texts = {str(i): f"alpha {'beta ' * (i % 4)} word{i}" for i in range(30)} | {"x": None, "y": "!!"}
    vectors = {k: [float(int(k) % 5), 1.0] for k in texts if k.isdigit()}

    def frame():
        return spark.createDataFrame([(k, t, vectors.get(k)) for k, t in texts.items()], "key string, content string, vector array<double>")

    for round_ in range(10):  # more than are kept apart
        version = search_index.update(spark, folder, frame(), f"op{round_}")
        assert search_index.update(spark, folder, frame(), f"op{round_}") == version
        got = [tuple(r) for r in search_index.lexical(spark, folder, "Beta, word3 gamma?", 100).collect()]
        assert got == bm25(texts, "beta word3 gamma")
        texts[str(round_)] = f"gamma {'beta ' * round_}"
        texts[f"new{round_}"] = "beta new"
        texts.pop(str(29 - round_))
        vectors[str(round_)] = [100.0, 1.0]
    content = commits.current(spark, folder)[1]
    assert len(content["postings"]) <= search_index.MOST_GENERATIONS
    changed = {r.change: r["count"] for r in search_index.changes(spark, folder, frame()).groupBy("change").count().collect()}
    assert changed == {"added": 1, "changed": 1, "deleted": 1, "same": len(texts) - 2}
    near = [r.key for r in search_index.nearest(spark, folder, [1.0, 0.0], 9).collect()]
    assert near == sorted(map(str, range(9)))
    search_index.compact(spark, folder)
    assert commits.current(spark, folder)[1]["dead"] == []
    assert [r.key for r in search_index.lexical(spark, folder, "word18").collect()] == ["18"]
    assert search_index.lexical(spark, folder, "?!").count() == 0


def test_a_question_reads_its_terms_alone(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = spark.range(500).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("common word"), F.col("id").cast("string")).alias("content"))
    search_index.update(spark, folder, rows)
    hits = search_index.lexical(spark, folder, "word17")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "term" in plan.split("PushedFilters")[1].split("]")[0]
    assert [r.key for r in hits.collect()] == ["17"]
    asked = search_index._asked(spark, ["word17"])
    files = search_index._table(spark, folder, search_index._POSTINGS, commits.current(spark, folder)[1]["postings"]).where(asked)
    assert files.select("bucket").distinct().count() == 1


def test_fused_ranks(spark):
    a = spark.createDataFrame([("p", 9.0), ("q", 5.0), ("r", 1.0)], "key string, score double")
    b = spark.createDataFrame([("r", 0.9), ("s", 0.8)], "key string, similarity double")
    got = search_index.fused(a, b).collect()
    assert [(r.key, r.lexical_rank, r.vector_rank) for r in got] == [("r", 3, 1), ("p", 1, None), ("q", 2, None), ("s", None, 2)]
    assert got[0].score == round(1 / 63 + 1 / 61, 9)


def test_terms_are_counted_within_their_rows(spark):
    rows = [("a", "b a B c, a b 3"), ("b", ""), ("c", None), ("d", "é É e"), ("e", "one"), ("f", "!!")] + [(f"g{i}", " ".join(f"w{j % 7}" for j in range(i))) for i in range(60)]
    made = retrieval.lexical_index(spark.createDataFrame(rows, "key string, content string"), "key", "content")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    expected = set()
    for key, content in rows:
        words = re.findall(r"[^\W_]+", (content or "").lower())
        expected |= {(key, len(words), w, n) for w, n in Counter(words).items()}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(expected) and set(got) == expected
    assert dict(made.dtypes) == {"key": "string", "doc_length": "int", "term": "string", "tf": "bigint"}
