"""Mentions of many titles against one replacement after the other."""

import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from vaultry.operators import mentions


def replaced(content, stem):
    """One title in one note, by a pattern, as it is done by hand."""
    target = re.compile(r"(?<!\w)" + re.escape(stem) + r"(?:\.md)?(?!\w)")
    skip = re.compile(r"\[\[[^\]\n]+\]\]|\[(?:[^\]\n]*)\]\([^)\n]*\)|`[^`\n]*`")
    lines, n, out = content.splitlines(keepends=True), 0, []
    body = 0
    if lines and lines[0].strip() == "---":
        body = next((i + 1 for i, x in enumerate(lines) if i and x.strip() in ("---", "...")), 0)
    for i, line in enumerate(lines):
        last, parts = 0, []
        for m in [] if i < body else skip.finditer(line):
            new, k = target.subn(f"[[{stem}]]", line[last : m.start()])
            parts += [new, m[0]]
            n, last = n + k, m.end()
        new, k = (line[last:], 0) if i < body else target.subn(lambda _: f"[[{stem}]]", line[last:])
        out.append("".join(parts) + new)
        n += k
    return "".join(out), n


def walked(notes, orphans):
    notes, counts = dict(notes), {}
    for o in sorted(orphans):
        stem = o.rsplit("/", 1)[1].removesuffix(".md")
        if len(stem) < 3:
            continue
        for path in sorted(notes):
            if path != o and stem in notes[path]:
                notes[path], n = replaced(notes[path], stem)
                if n:
                    counts[path, o] = n
    return notes, counts


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_one_title_after_the_other(spark, seed, monkeypatch):
    monkeypatch.setattr(mentions, "SHARD", 4)  # several shards
    rng = random.Random(seed)
    words = ["alpha", "beta", "alpha beta", "beta gamma", "gamma", "alpha.md", ".beta", "é-x", "a", "ab", "alphabet", "c++", "x_1", "beta-"]
    orphans = [f"wiki/{rng.choice('ab')}/{w}.md" for w in words] + ["wiki/c/alpha.md", "wiki/c/gamma.md"]
    bits = [*words, "alpha.md", "beta.mdx", "[[beta]]", "[alpha](u)", "`gamma beta`", "\n", " ", " ", " ", "_", "-", ".", "```", "\x0b", "[x", "]", "word"]
    notes = {o: "" for o in orphans} | {f"wiki/n/{i}.md": "" for i in range(40)}
    for path in notes:
        head = rng.choice(["", "---\nt: alpha\n---\n", "---\nalpha\n"])
        notes[path] = head + "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
    want, counts = walked(notes, orphans)
    rows = mentions.linked(
        spark.createDataFrame(list(notes.items()), "path string, content string"), spark.createDataFrame([(o,) for o in orphans], "path string")
    ).collect()
    got = {r.path: r.content for r in rows}
    assert {p: (got[p], want[p]) for p in notes if got[p] != want[p]} == {}
    assert {(r.path, x.page): x.n for r in rows for x in r.links} == counts
    assert {r.path for r in rows if r.changed} == {p for p, _ in counts}


def test_repairs(spark):
    notes = {
        "wiki/a/Linked One.md": "---\norphan: false\nt: 1\n---\nx", "wiki/a/Raw Only.md": "body", "wiki/a/Known.md": "---\norphan: false\n---\n",
        "wiki/a/Nobody.md": "Nobody says Nobody", "wiki/a/zz.md": "zz", "wiki/n/n.md": "see Linked One and Linked One.md, zz",
    }
    orphans = [p for p in notes if p.startswith("wiki/a/")]
    raw = [("raw/r.txt", "about Raw Only.\nKnown Nobodys"), ("raw/s.txt", None)]
    n = spark.createDataFrame(list(notes.items()), "path string, content string")
    o = spark.createDataFrame([(x,) for x in orphans], "path string")
    r = spark.createDataFrame(raw, "path string, content string")
    got = {x.path: (x.references_linked, x.files_changed, x.frontmatter) for x in mentions.repairs(n, r, o).collect()}
    assert got == {
        "wiki/a/Linked One.md": (2, 1, "removed_orphan_false"), "wiki/a/Raw Only.md": (0, 0, "added_orphan_false"), "wiki/a/Known.md": (0, 0, None),
        "wiki/a/Nobody.md": (0, 0, None), "wiki/a/zz.md": (0, 0, None),
    }
    after = {x.path: x.content for x in mentions.repaired(n, r, o).where("changed").collect()}
    assert after == {
        "wiki/a/Linked One.md": "---\nt: 1\n---\nx", "wiki/a/Raw Only.md": "---\norphan: false\n---\nbody",
        "wiki/n/n.md": "see [[Linked One]] and [[Linked One]], zz",
    }


def test_nothing(spark):
    none = spark.createDataFrame([], "path string")
    notes = spark.createDataFrame([("a.md", "x"), ("b.md", None)], "path string, content string")
    assert mentions.linked(notes, none).where("changed").count() == 0
    assert mentions.mentioned(notes, none.withColumnRenamed("path", "stem")).agg(F.count("stem")).first()[0] == 0


def test_an_occurrence_is_three_numbers(spark):
    words = [f"word{i}" for i in range(50)]
    stems = spark.createDataFrame([(w, f"wiki/a/{w}.md", None) for w in words], "stem string, first string, second string")
    folder = mentions._sharded(stems)
    text = " ".join(words[i * 7 % 50] for i in range(60_000))
    tracemalloc.start()
    try:
        found, pages = mentions._occurrences(folder, mentions._files(folder), [("x", text), ("y", "word3"), ("z", "")])
        size = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    places = sorted((found[0][i], found[0][i + 1], pages[found[0][i + 2]][0]) for i in range(0, len(found[0]), 3))
    assert places == sorted((m.start() + k.start(), m.start() + k.end(), f"wiki/a/{k[0]}.md") for m in re.finditer(r"\S+", text) for w in {m[0], m[0][:5]} & set(words) for k in [re.match(w, m[0])])
    assert [pages[i][0] for i in found[1][2::3]] == ["wiki/a/word3.md"] and not found[2]
    assert size < 40 * len(places) + 200_000


def test_repairs_go_through_the_notes_once_for_their_links(spark, monkeypatch):
    """Titles for the raw texts, their count and the result all need the links of the notes."""
    read = spark.sparkContext.accumulator(0)
    plain = mentions.linked

    def counted(notes, orphans, **kwargs):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return plain(notes.mapInArrow(run, notes.schema), orphans, **kwargs)

    monkeypatch.setattr(mentions, "linked", counted)
    notes = spark.createDataFrame([("wiki/a/alpha.md", "---\norphan: false\n---\nbeta"), ("wiki/a/beta.md", "x"), ("wiki/a/gamma.md", "orphan: false")], "path string, content string")
    raw = spark.createDataFrame([("raw/a.md", "gamma")], "path string, content string")
    rows = mentions.repairs(notes, raw, notes.select("path")).collect()
    assert sorted((r["path"], r["references_linked"], r["frontmatter"]) for r in rows) == [
        ("wiki/a/alpha.md", 0, None), ("wiki/a/beta.md", 1, None), ("wiki/a/gamma.md", 0, "added_orphan_false")
    ]
    assert read.value == 3
