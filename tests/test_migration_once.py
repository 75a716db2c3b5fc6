"""A migration parses its notes once, whatever kinds of edits follow."""

from vaultry.operators import edits


def test_notes_are_parsed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("raw/n/a.md", '---\nsource: "c/p.pdf"\n---\n[[p.pdf]] [t](c/p.pdf)'), ("raw/n/b.md", "[[a]] ![i](c/p.pdf)")]
    plain = spark.createDataFrame(rows, "path string, content string")
    files = spark.createDataFrame([("raw/n/a.md",), ("raw/n/b.md",), ("raw/n/c/p.pdf",)], "path string")
    moves = spark.createDataFrame([("raw/n/c/p.pdf", "raw/n/d/q.pdf")], "old string, new string")
    notes = plain.mapInArrow(run, "path string, content string")
    found = {(r.path, r.start, r.text) for r in edits.migration_edits(notes, files, moves).collect()}
    assert found == {
        ("raw/n/a.md", 13, "d/q.pdf"), ("raw/n/a.md", 28, "raw/n/d/q.pdf"), ("raw/n/a.md", 40, "raw/n/d/q.pdf"), ("raw/n/b.md", 11, "raw/n/d/q.pdf"),
    }
    assert made.value == 2 * len(rows)  # once for the links, once for the paths
