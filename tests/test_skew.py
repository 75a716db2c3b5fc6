"""Numbering and windows in buckets give what plain ones give."""

from pyspark.sql import functions as F

from vaultry.functions import skew


def test_rows_without_key_or_position_stay(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 9, 2), (None, 1, 3), (None, 7, 4), ("a", None, 5)], "k string, p long, v long")
    linked = skew.with_previous(df, ["k"], "p", ["v"], bucket=4)
    got = {r["v"]: r["previous"]["v"] if r["previous"] else None for r in linked.collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and got[2] == 1 and got[4] == 3
    assert skew.with_last_start(df, ["k"], "p", F.col("v") > 0, "s", bucket=4).count() == 5


def test_numbering_is_the_sorted_position(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 13).alias("a"))
    got = skew.numbered(df, [F.desc("a"), F.asc("id")], "n", partitions=6).collect()
    expected = sorted(((r["a"], r["id"]) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] == expected
    assert sorted(r["n"] for r in got) == list(range(1, 501))


def test_previous_row_and_last_start_cross_buckets(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), (F.col("id") * 3).alias("p"), (F.col("id") % 7).alias("v"))
    linked = skew.with_previous(df, ["k"], "p", ["v"], bucket=8)
    marked = skew.with_last_start(linked, ["k"], "p", F.col("v") == 0, "start", bucket=8).collect()
    for key in (0, 1):
        ordered = sorted((r for r in marked if r["k"] == key), key=lambda r: r["p"])
        last = None
        for i, row in enumerate(ordered):
            assert (row["previous"]["v"] if row["previous"] else None) == (ordered[i - 1]["v"] if i else None)
            last = row["p"] if row["v"] == 0 else last
            assert row["start"] == last


def test_first_k(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = skew.first_k(df, ["k"], [F.desc("v")], 2).select("k", "v").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [(0, 294), (0, 297), (1, 295), (1, 298), (2, 296), (2, 299)]
