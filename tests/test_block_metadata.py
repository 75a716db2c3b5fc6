"""Blocks, their metadata and the checks of a page come from the row of the page."""

from vaultry.operators import inventory, provenance

PAGE = """# T

One. ^a

Two. ^b

Three. ^a

> [!provenance]
> schema: kb-prov-v1
> blocks:
>   a:
>     status: current
>     sources: [raw/x.md]
>   b:
>     status: open
>   a:
>     status: stale
>   ghost:
"""


def test_nothing_is_shuffled_and_repeated_headers_are_one_block(spark):
    pages = spark.createDataFrame([("wiki/a/p.md", PAGE), ("wiki/a/q.md", "x ^a"), ("wiki/a/r.md", None)], "path string, content string")
    blocks, issues = inventory.index_blocks(pages), provenance.validate(pages)
    for df in (blocks, issues):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    assert [(r["path"], r["ordinal"], r["id"], r["status"], r["sources"], r["has_provenance"]) for r in sorted(blocks.collect())] == [
        ("wiki/a/p.md", 0, "a", "stale", ["raw/x.md"], True), ("wiki/a/p.md", 1, "b", "open", [], True),
        ("wiki/a/p.md", 2, "a", "stale", ["raw/x.md"], True), ("wiki/a/q.md", 0, "a", "unknown", [], False),
    ]
    assert sorted((r["block_id"], r["code"]) for r in issues.collect()) == [("a", "duplicate-block-id"), ("ghost", "missing-block-id")]
    known = provenance.block_metadata(provenance.callouts(pages)).collect()
    assert sorted((r["block_id"], r["position"], r["field_count"]) for r in known) == [("a", 0, 3), ("b", 3, 1), ("ghost", 7, 0)]
