"""Sides that grow with the vault are merged, however small their files seem."""

import pytest
from pyspark.sql import functions as F

from vaultry.operators import edits, fix_cycle, page_checks, relocation, vault_links


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan
    return plan


@pytest.fixture
def vault(spark, tmp_path):
    """Notes in a file far below the size at which Spark sends a table to the driver."""
    rows = spark.range(40).select(
        F.format_string("raw/n/Note %d.md", "id").alias("path"), F.format_string("[[Note %d]] [[note-%d]] [t](no%d.md)", F.col("id") + 1, "id", "id").alias("content")
    )
    rows.write.parquet(str(tmp_path / "notes"))
    return spark.read.parquet(str(tmp_path / "notes"))


def test_link_checks_broadcast_nothing(vault):
    files = vault.select("path")
    found = vault_links.extract(vault, images=True)
    bad = vault_links.broken(found, files)
    assert "Broadcast" not in joins(bad) and bad.count() == 40 + 1 + 40
    fixes = vault_links.suggestions(bad.where("wiki_style"), files)
    assert "Broadcast" not in joins(fixes) and {r.suggested_fix for r in fixes.collect()} == {f"Note {i}" for i in range(40)}
    context = vault_links.source_context(bad, vault)
    assert "Broadcast" not in joins(context) and context.count() == 40


def test_backlinks_broadcast_nothing(vault):
    files = vault.select("path")
    edges = page_checks.note_wikilinks(vault)
    assert "Broadcast" not in joins(page_checks.backlinks(edges, files, files))
    assert "Broadcast" not in joins(page_checks.unlinked(files, edges, files))


def test_moves_broadcast_nothing(vault):
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    moves = vault.select(F.col("path").alias("old"), F.concat(F.lit("raw/m/"), name).alias("new"))
    targets = vault.select(name.alias("target"), F.lit("raw/x").alias("folder"))
    out = relocation.moved_targets(targets, moves)
    assert "Broadcast" not in joins(out) and out.where("new_path = concat('raw/m/', target)").count() == 40


def test_edits_and_repairs_broadcast_nothing(vault):
    files = vault.select("path")
    moves = files.select(F.col("path").alias("old"), F.regexp_replace("path", "raw/n/", "raw/m/Moved ").alias("new"))
    changed = edits.migration_edits(vault, files, moves)
    assert "Broadcast" not in joins(changed) and changed.count() == 39
    assert "Broadcast" not in joins(edits.applied(vault, changed))
    bad = vault_links.broken(vault_links.extract(vault, images=True), files)
    assert "Broadcast" not in joins(fix_cycle.one_round(vault, bad, files))
