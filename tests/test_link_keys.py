"""Links and their targets: few rows for each, whatever the spelling."""

import re

from pyspark.sql import functions as F

from vaultry.functions import text
from vaultry.operators import vault_links

FILES = ["wiki/a/Page.md", "wiki/a/b’s.md", "wiki/a/d.md.md", "raw/n/pic.png", "raw/n/Note.md", "raw/.md", "Top.md", "index.md"]


def frame(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def test_a_plain_target_and_a_plain_page_have_few_keys(spark):
    targets = frame(spark, ["Page", "wiki/a/Page", "a/Page.md", "Page .md"], "target").select(F.lit(True).alias("wiki_style"), "target", F.lit("").alias("_folder"))
    rows = vault_links._target_keys(targets).groupBy("target").count().collect()
    assert {r["target"]: r["count"] for r in rows} == {"Page": 1, "wiki/a/Page": 1, "a/Page.md": 2, "Page .md": 2}
    keys = vault_links.file_keys(frame(spark, ["wiki/a/Page.md", "wiki/a/Other.md"], "path"))
    assert sorted(r.key for r in keys.collect()) == sorted(
        ["wiki/a/Page", "a/Page", "Page", "wiki/a/Other", "a/Other", "Other", "wiki", "wiki/a", "a"]
    )


def test_spellings_that_exist(spark):
    good = ["Page", "a/Page", "wiki/a/Page.md", "./Page", "wiki", "wiki/a", "b's", "b’s", "d.md", "n/pic", "raw/n/pic.png", "pic.png", "Page.pdf", "Note",
            "wiki//a/./Page", "Top", "Top.md", "wiki/x/../a/Page"]
    bad = ["pic", "page", "../Page", "wiki/Page", "x/Page", "Pag", "a/Page.png", "index.pdf", "/wiki/a/Page", "b`s", "/Top.md", "a", "n", "d", "x/../Page"]
    notes = spark.createDataFrame([(f"raw/n/{i}.md", f"[[{t}]]") for i, t in enumerate(good + bad)], "path string, content string")
    found = vault_links.broken(vault_links.extract(notes), frame(spark, FILES, "path"))
    missing = {r.target for r in found.collect()}
    assert missing == set(bad)


def test_no_array_of_links_is_built(spark):
    notes = spark.createDataFrame([("a.md", "---\nx: [[a]]\n---\r\n![[b]] [[c|d]]\x0b[t](e) ![i](f#g)")], "path string, content string")
    found = vault_links.extract(notes, images=True)
    assert [tuple(r) for r in found.select("line", "position", "type", "target", "in_front_matter").orderBy("line", "position").collect()] == [
        (2, 0, "wikilink", "a", True), (4, 0, "wikilink", "c", False), (4, 1, "image", "b", False), (5, 0, "markdown", "e", False), (5, 1, "image", "f", False),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # matches are made in compiled projections, a row for each line, not in a lambda over all lines
    assert "posexplode" in plan and not re.search(r"lambdafunction\([^\n]*regexp_extract_all", plan)


def test_strip_is_the_pattern(spark):
    codes = spark.range(0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    given = codes.select(F.concat("c", F.lit("a"), "c", F.lit("b"), "c").alias("t"))
    by_pattern = F.regexp_replace("t", rf"(?U)\A{text.SPACE}+|{text.SPACE}+\z", "")
    assert given.where(~text.strip(F.col("t")).eqNullSafe(by_pattern)).count() == 0


def test_targets_of_suggestions_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    targets = frame(spark, ["No_te", "a/pag_e", "Page .md", "gone", "pic .png"], "target").mapInArrow(run, "target string")
    rows = vault_links.suggestions(targets, frame(spark, [*FILES, "raw/n/No te.md", "a/Pag e.md"], "path")).collect()
    assert {r.target: (r.suggested_fix, r.rule) for r in rows} == {
        "No_te": ("No te", "fuzzy"), "a/pag_e": ("a/Pag e", "fuzzy"), "Page .md": ("Page", "fuzzy"), "pic .png": ("pic.png", "space"),
    }
    assert made.value == 5
