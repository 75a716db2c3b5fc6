"""Evidence of a title: relations are read once, whatever is counted and listed; days and titles have a short way."""

from pyspark.sql import functions as F

from vaultry.functions import names, text
from vaultry.operators import drift
from vaultry.operators.page_state import day_of, latest_day, valid_day

ROWS = [("hot", f"raw/{i % 40}/n{i % 3}.md", None if i % 4 == 0 else f"2024-0{i % 9 + 1}-0{i % 7 + 1}") for i in range(300)] + [
    ("two", "raw/a/b.md", "2024-01-02"), ("two", "raw/a b.md", "soon"), ("two", "raw/a/b.md", "2023-1-5"), ("two", "raw/a b.md", None),
    ("none", "raw/x.md", None), ("none", None, "2024-02-30"), ("far", "raw/x.md", "+12345-1-1"), ("far", "raw/y.md", "2024-01-01"), (None, "raw/z.md", "2024-01-01"),
]
SCHEMA = "title_key string, note string, date string"


def test_relations_are_read_once_and_nothing_is_lost(spark):
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    out = drift.evidence_by_title(spark.createDataFrame(ROWS, SCHEMA).mapInArrow(run, SCHEMA), 10)
    got = {r["title_key"]: (r["related_raw_count"], r["latest_related_raw_date"], r["related_raw"]) for r in out.collect()}
    assert read.value == len(ROWS)
    hot = sorted({n for t, n, _ in ROWS if t == "hot"}, key=lambda n: n.replace("/", "\x01"))
    first = {n: min((d for t, m, d in ROWS if t == "hot" and m == n and d), default=None) for n in hot}
    assert got == {
        "hot": (len(hot), max(d for d in first.values() if d), hot[:10]),
        # the least text of a note counts: "2023-1-5"; "soon" is no date
        "two": (2, "2023-01-05", ["raw/a/b.md", "raw/a b.md"]), "none": (2, None, [None, "raw/x.md"]), "far": (2, "2024-01-01", ["raw/x.md", "raw/y.md"]),
    }


def test_usual_days_are_cast_with_the_same_result(spark):
    values = ["2024-01-05", "2024-1-5", "2024-02-30", "0000-01-01", "0001-01-01", "9999-12-31", "2024-01-05T10:00", "24-01-05", "+12345-1-1", "", "x", None, "２024-01-01", "2024-13-01", " 2024-01-0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    by_pattern = F.try_to_date(F.substring("v", 1, 10), "yyyy-M-d")
    for r in df.select("v", day_of(F.col("v")).cast("string").alias("a"), by_pattern.cast("string").alias("b")).collect():
        assert r["a"] == r["b"], r["v"]
    row = df.select(latest_day(F.col("v")).alias("a"), F.max(valid_day(F.col("v"))).alias("b")).first()
    assert row["a"] == row["b"] == "9999-12-31"
    far = df.where("v LIKE '+%'").select(latest_day(F.col("v")).alias("a"), F.max(valid_day(F.col("v"))).alias("b")).first()
    assert far["a"] == far["b"]


def test_latest_days_need_no_sorted_aggregate(spark):
    df = spark.range(9).select((F.col("id") % 2).alias("k"), F.format_string("2024-01-0%d", F.col("id") + 1).alias("v"))
    out = df.groupBy("k").agg(latest_day(F.col("v")).alias("d"))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(0, "2024-01-09"), (1, "2024-01-08")}


def test_plain_titles_have_the_same_key(spark):
    titles = ["Part 1", " Part 1", "Part  1", "Part 1 ", "", " ", "ÀB c", "a\tb", "a  b", "A", "a\n", "\x1cA b", "A" * 5000 + " b", None]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    slow = text.collapse_spaces(F.lower(text.strip(F.col("t"))))
    assert all(r["a"] == r["b"] for r in df.select(names.plain_title(F.col("t")).alias("a"), slow.alias("b")).collect())
