"""One structural check of a whole vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import page_checks, vault_links


def check(notes: DataFrame, files: DataFrame, images: bool = False, skip_front_matter: bool = False) -> dict[str, DataFrame]:
    """Broken links with suggestions, orphans, stubs, loose files and old folders.

    ``notes``: path, content; ``files``: path of every vault file.
    """
    scanned = notes.where(paths.is_scanned_page(F.col("path")))
    found = vault_links.extract(scanned, images, skip_front_matter)
    broken = vault_links.broken(found, files)
    fixes = vault_links.suggestions(broken.where("wiki_style").select("target"), files)
    return {
        "links": found,
        "broken_links": broken.join(fixes.select("target", "suggested_fix"), "target", "left"),
        "orphans": page_checks.orphans(notes, files),
        "stubs": page_checks.stubs(notes),
        "loose_files": page_checks.loose_files(files),
        "legacy_folders": page_checks.legacy_folders(files),
    }


def summary(notes: DataFrame, found: DataFrame, broken: DataFrame) -> DataFrame:
    """One row: files_checked, links_checked, broken, skipped_external."""
    checked = vault_links.checked_links(found).agg(
        F.count(F.lit(1)).alias("links_checked"), F.count_if("external").alias("skipped_external")
    )
    files = notes.where(paths.is_scanned_page(F.col("path"))).agg(F.count(F.lit(1)))
    bad = broken.agg(F.count(F.lit(1)))
    return checked.select(
        files.scalar().alias("files_checked"), "links_checked", bad.scalar().alias("broken"), "skipped_external"
    )
