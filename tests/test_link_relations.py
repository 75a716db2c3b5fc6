"""Relations between notes: found in the whole text, resolved in one pass."""

from vaultry.functions import links
from vaultry.operators import page_checks, vault_links

ODD = [
    "[[a]] ![[b]] [[c|x]] [[d\\|y]] [[e\\f]] [[g]h]] [[]] [[ i ]] [[ j ]]", "[[k\n]] [[l\r\nm]] [[n o]] [[p\x0bq]] [[r\x85s]] [[t\\\nu]] [[v]\nw]]",
    "[[gone|(broken link) gone]] [[gone\\|(broken link) x]] [[[[x]]]] [[#y]] [[https://z]] [[a#b]]", "---\nsee: [[front]]\n---\n[[end", "![x](y) [t](u) [[a]] [[a]]\n![[c]]\n[[",
    "no links", "", "[[\x1c]] [[ ]] [[tab\t]] [[﻿bom]]", "!\n[[after]] !\r[[mark]] ![[no]]\x1d[[yes]]", "[[a]]\r[[b]]\x0c[[c]]\x1e[[d]] [[e]]\n",
]


def test_targets_of_a_whole_text_are_those_of_its_lines(spark):
    notes = spark.createDataFrame([(f"raw/{i}.md", t) for i, t in enumerate([*ODD, None])], "path string, content string")
    by_line = {}
    for r in vault_links.extract(notes).where("type = 'wikilink'").orderBy("path", "line", "position").collect():
        by_line.setdefault(r["path"], []).append(r["target"])
    whole = notes.where("content IS NOT NULL").select("path", links.wikilink_targets(notes["content"]).alias("t")).collect()
    assert {r["path"]: r["t"] for r in whole if r["t"]} == by_line
    counted = {(p, t) for p, ts in by_line.items() for t in ts if t and not t.startswith("#") and not t.startswith("https://")}
    edges = [tuple(r) for r in page_checks.note_wikilinks(notes).collect()]
    assert len(edges) == len(set(edges)) and set(edges) == counted


def test_resolution_reads_the_targets_once(spark):
    read = spark.sparkContext.accumulator(0)
    targets = ["One", "a/Two", "wiki/a/One", "raw/r.md", "r", "Three", "/One", "../up", "b/Pic.png", "Two.md", "x/../One", "Twice"]
    rows = spark.createDataFrame([(t,) for t in targets], "target string")

    def run(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([(p,) for p in ("One.md", "wiki/a/One.md", "wiki/a/Two.md", "raw/r.md", "raw/b/Pic.png", "wiki/a/Twice.md", "wiki/b/Twice.md")], "path string")
    out = vault_links.resolve_to_page(rows.mapInArrow(run, "target string"), files, files.where("path LIKE 'wiki/%'"))
    assert {r["target"]: r["path"] for r in out.collect()} == {
        "One": "One.md", "a/Two": "wiki/a/Two.md", "wiki/a/One": "wiki/a/One.md", "raw/r.md": "raw/r.md", "b/Pic.png": "raw/b/Pic.png",
        "/One": "wiki/a/One.md", "Two.md": "wiki/a/Two.md", "x/../One": "One.md"}
    assert read.value == len(targets)


def test_orphans_say_so_in_any_spelling(spark):
    texts = {"A": "---\norphan : false \n---\n", "B": "---\nnot an orphan: false\n---\n", "C": "orphan: false", "D": None, "E": "---\norphan: false", "F": "---\na: b\n---\n[[B]]"}
    notes = spark.createDataFrame([(f"wiki/a/{k}.md", t) for k, t in texts.items()], "path string, content string")
    assert {r["path"][7] for r in page_checks.orphans(notes, notes.select("path")).collect()} == {"C", "D"}
