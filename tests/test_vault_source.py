"""Listing in tasks, reading by size, the view after moves."""

import os

from pyspark.sql import functions as F

from vaultry.sources import vault


def walked(root):
    out = set()
    for base, folders, files in os.walk(root):
        folders[:] = [d for d in folders if not d.startswith(".")]
        out |= {os.path.relpath(os.path.join(base, f), root) for f in files}
    return out


def test_listing_equals_a_walk(spark, tmp_path):
    for rel in ("a.md", "wiki/_index.md", "wiki/x/y/z/deep.md", "raw/_resources/p.pdf", ".git/hidden", "raw/.obsidian/c", "raw/n.resources/q", "raw/.dot.md"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text(rel * 3)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "wiki", tmp_path / "raw" / "loop")
    files = vault.read(spark, str(tmp_path), split_bytes=40)
    got = {r.path: r for r in files.collect()}
    assert set(got) == walked(str(tmp_path))
    assert all(bytes(r.content) == (p * 3).encode() and r.length == 3 * len(p) for p, r in got.items())
    moved = vault.after_moves(vault.as_text(files), spark.createDataFrame([("a.md", "wiki/b.md")], "old string, new string"))
    assert {r.path: r.content for r in moved.where("path LIKE '%b.md'").collect()} == {"wiki/b.md": "a.md" * 3}
    assert vault.read(spark, str(tmp_path / "empty")).count() == 0


def test_a_flat_folder_is_many_tasks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for i in range(20_000):
        (tmp_path / "raw" / f"n{i}.md").write_bytes(b"x")
    files = vault.read(spark, str(tmp_path))
    assert files.count() == 20_000
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)
