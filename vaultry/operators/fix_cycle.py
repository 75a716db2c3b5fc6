"""Broken links repaired until nothing changes: suggest, apply, extract and resolve again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import shuffled
from ..session import checkpointed
from . import rewrite, vault_links


@dataclass(frozen=True)
class Repair:
    """``notes``: path, content of the changed notes; ``broken``: links that are still broken; ``summary``: type, found, fixed, remaining."""

    notes: DataFrame
    broken: DataFrame
    summary: DataFrame
    rounds: int


def one_round(notes: DataFrame, broken: DataFrame, files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Notes that change (path, content): suggested targets are put in, broken wikilinks of front matter without a suggestion go.

    ``known``: target, suggested_fix of the broken targets, looked up in ``files`` unless given.
    """
    wiki = broken.where("wiki_style")
    if known is None:
        known = checkpointed(vault_links.suggestions(wiki, files))
    named = wiki.select("path", "target", "in_front_matter", "raw").join(shuffled(known.select("target", "suggested_fix")), "target", "left")
    hopeless = F.col("suggested_fix").isNull() & F.col("in_front_matter") & F.col("raw").startswith("[[")
    edits = named.where((F.col("suggested_fix") != F.col("target")) | hopeless).select("path", "target", "suggested_fix")
    return rewrite.fixed_links(notes, edits).select("path", "content")


def repair(notes: DataFrame, files: DataFrame, most_rounds: int | None = None) -> Repair:
    """Repair the links of ``notes`` (path, content) against the vault's ``files`` (path) up to a fixed point.

    Only notes that changed are read again, and only targets that no earlier round had are looked up, since the files stay.  A link counts as
    fixed when it is no longer among the broken ones at the end, put right or deleted.
    A text that keeps changing would go on for ever; ``most_rounds`` ends it.
    """
    notes = checkpointed(notes.select("path", "content"))
    keys = checkpointed(vault_links.file_keys(files))

    def broken_links(of: DataFrame) -> DataFrame:
        # resolution reads the links twice; parsing the notes once is cheaper
        return vault_links.broken(checkpointed(vault_links.extract(of, images=True)), files, keys)

    broken = checkpointed(broken_links(notes))
    first, changed, rounds, asked, known = broken, None, 0, None, None
    while most_rounds is None or rounds < most_rounds:
        targets = broken.where("wiki_style").select("target").distinct()
        if asked is not None:
            targets = checkpointed(targets.join(shuffled(asked), "target", "left_anti"))
        if known is None or not targets.isEmpty():
            found = vault_links.suggestions(targets, files, keys).select("target", "suggested_fix")
            known = checkpointed(found if known is None else known.unionByName(found))
            asked = targets if asked is None else checkpointed(asked.unionByName(targets))
        new = checkpointed(one_round(notes, broken, files, known))
        if new.isEmpty():
            break
        rounds += 1
        broken = checkpointed(broken.join(shuffled(new.select("path")), "path", "left_anti").unionByName(broken_links(new)))
        changed = new if changed is None else checkpointed(changed.join(shuffled(new.select("path")), "path", "left_anti").unionByName(new))
        notes = new  # what did not change has nothing that can change
    found = first.groupBy("type").agg(F.count(F.lit(1)).alias("found"))
    left = broken.groupBy("type").agg(F.count(F.lit(1)).alias("remaining"))
    summary = found.join(left, "type", "left").na.fill(0, ["remaining"]).select(
        "type", "found", (F.col("found") - F.col("remaining")).alias("fixed"), "remaining"
    )
    return Repair(notes.limit(0) if changed is None else changed, broken, summary, rounds)


def summary_lines(summary: DataFrame) -> DataFrame:
    """The report's lines on broken links (at, line): one of all, one of each type in order."""
    total = summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "fixed", "remaining")])
    counts = "%d found, %d fixed, %d remaining"
    head = total.select(F.lit("").alias("at"), F.format_string(f"  broken links : {counts}", "found", "fixed", "remaining").alias("line"))
    types = summary.select(F.col("type").alias("at"), F.format_string(f"     %-10s: {counts}", "type", "found", "fixed", "remaining").alias("line"))
    return head.unionByName(types)
