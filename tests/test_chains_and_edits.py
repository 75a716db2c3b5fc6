"""Long chains of successors, as-of joins, edits by offset."""

import random

from pyspark.sql import functions as F

from vaultry.functions import skew
from vaultry.operators import edits, relocation, supersession


def test_a_long_chain_without_a_ring(spark):
    chain = spark.range(100_000).select(
        F.format_string("p%07d", "id").alias("path"), F.format_string("p%07d", F.col("id") + 1).alias("resolved"), F.lit("resolved").alias("outcome"), F.lit(0).alias("position")
    )
    ring = spark.createDataFrame([("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("t1", "t2"), ("t2", "r2"), ("s", "s")], "path string, resolved string")
    edges = chain.unionByName(ring.withColumns({"outcome": F.lit("resolved"), "position": F.lit(0)}))
    got = {r.path: r.cycle for r in supersession.cycles(edges).collect()}
    assert got == {
        "r1": "r1 -> r2 -> r3 -> r1", "r2": "r2 -> r3 -> r1 -> r2", "r3": "r3 -> r1 -> r2 -> r3", "s": "s -> s",
        "t1": "t1 -> t2 -> r2 -> r3 -> r1 -> r2", "t2": "t2 -> r2 -> r3 -> r1 -> r2",
    }


def test_first_key_at_or_after(spark):
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ab/é😀") for _ in range(rng.randint(1, 4))) for _ in range(60)}, key=lambda k: k.encode())
    starts = ["", "a", "zzz", "😀😀😀😀😀", *rng.sample(keys, 10), *["".join(rng.choice("ab/é") for _ in range(2)) for _ in range(20)]]
    got = skew.first_from(spark.createDataFrame([(s,) for s in starts], "start string"), spark.createDataFrame([(k,) for k in keys], "key string"), 5).collect()
    assert {r.start: r.key for r in got} == {s: next((k for k in keys if k.encode() >= s.encode()), None) for s in set(starts)}
    none = spark.createDataFrame([], "key string")
    assert [r.key for r in skew.first_from(spark.createDataFrame([("x",)], "start string"), none).collect()] == [None]


def test_edits_in_one_pass(spark):
    notes = spark.createDataFrame([("a", "0123456789"), ("b", "é😀x"), ("c", None), ("d", "untouched")], "path string, content string")
    rows = [("a", 8, 10, "END"), ("a", 2, 4, ""), ("a", 3, 5, "no"), ("a", 2, 2, "+"), ("a", 10, 11, "out"), ("b", 1, 2, "y"), ("c", 0, 0, "new"), ("a", -1, 0, "no"), ("x", 0, 0, "?")]
    got = {r.path: (r.content, r.applied) for r in edits.applied(notes, spark.createDataFrame(rows, "path string, start long, stop long, text string")).collect()}
    assert got == {"a": ("01+4567END", 3), "b": ("éyx", 1), "c": ("new", 1)}


def test_a_name_that_many_moved_files_have(spark):
    moves = [(f"raw/f{i % 40}/d{i}/same.pdf", f"raw/new/{i}.pdf") for i in range(600)]
    asked = [("same.pdf", f"raw/f{i % 50}/d{i}/notes") for i in range(300)]
    got = {(r.target, r.folder): r.new_path for r in relocation.moved_targets(
        spark.createDataFrame(asked, "target string, folder string"), spark.createDataFrame(moves, "old string, new string")).collect()}

    def common(old, folder):
        n = 0
        for a, b in zip(old.split("/"), folder.split("/")):
            if a != b:
                break
            n += 1
        return n

    assert got == {(t, f): min(moves, key=lambda m: (-common(m[0], f), len(m[0]), m[0]))[1] for t, f in asked}
