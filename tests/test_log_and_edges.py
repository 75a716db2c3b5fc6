"""Pruning reduces before it joins; counters of edges parse their pages once."""

from vaultry.operators import ledger, supersession
from vaultry.sources import ledger as log_source


def test_prune_reduces_entries_before_they_meet_the_files(spark):
    lines = [(i, f'{{"date": "2024-01-0{i % 3 + 1}", "file": "raw/{i % 2}.md", "summary": "{i}"}}') for i in range(9)]
    log = log_source.parse_lines(spark.createDataFrame(lines, "line_no bigint, value string"))
    out = ledger.prune(log, spark.createDataFrame([("raw/1.md",)], "path string"))
    assert [(r["file"], r["summary"], r["entries"]) for r in out.collect()] == [("raw/1.md", "5", 4)]
    plan = ledger.prune(log, spark.createDataFrame([("raw/1.md",)], "path string"))._jdf.queryExecution().optimizedPlan().toString()
    first = plan[plan.index("LeftSemi"):]
    assert "max_by" in first


def test_counters_parse_the_pages_once(spark):
    read = spark.sparkContext.accumulator(0)
    pages = spark.createDataFrame([("wiki/a/p.md", "---\nsuperseded_by: q\n---\n"), ("wiki/a/q.md", "---\nsuperseded_by: p\n---\n")], "path string, content string")

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    forward = supersession.resolve(supersession.declared(pages, "superseded_by"), pages).mapInArrow(
        run, "target string, path string, position int, resolved string, outcome string"
    )
    back = supersession.resolve(supersession.declared(pages, "supersedes"), pages)
    row = supersession.counters(forward, back).first()
    assert (row["pages_superseded"], row["dangling"], row["missing_reciprocal"], row["cycles"]) == (2, 0, 2, 2)
    # a checkpoint computes its last stage twice: once to count, once to write
    assert read.value <= 4
