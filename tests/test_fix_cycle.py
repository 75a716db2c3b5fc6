"""Repair of links up to a fixed point."""

from vaultry.operators import fix_cycle


def test_repair_ends_where_nothing_changes(spark):
    notes = {
        "wiki/a/One.md": "[[two page]] and [[Two_Page|x]], ![[gone.png]]", "wiki/a/Two Page.md": "[[Nowhere]] [[One]] [t](no.md)",
        "wiki/a/Fm.md": "---\nrelated:\n  - [[Nowhere]]\n  - [[one]]\nup: [[Lost]]\n---\n[[Nowhere]] stays? [[Two Page]]", "wiki/a/Fine.md": "[[One]]",
        "wiki/a/Bar.md": "[[two_page\\|x]]",
    }
    n = spark.createDataFrame(list(notes.items()), "path string, content string")
    done = fix_cycle.repair(n, n.select("path"))
    assert {r.path: r.content for r in done.notes.collect()} == {
        "wiki/a/One.md": "[[Two Page]] and [[Two Page|x]], ![[gone.png]]",
        "wiki/a/Fm.md": "---\nrelated:\n  - [[One]]\nup:\n---\nstays? [[Two Page]]",
    }
    assert sorted((r.path, r.target) for r in done.broken.collect()) == [
        ("wiki/a/Bar.md", "two_page"), ("wiki/a/One.md", "gone.png"), ("wiki/a/Two Page.md", "Nowhere"), ("wiki/a/Two Page.md", "no.md"),
    ]
    got = {r.type: (r.found, r.fixed, r.remaining) for r in done.summary.collect()}
    assert got == {"wikilink": (8, 6, 2), "image": (1, 0, 1), "markdown": (1, 0, 1)}
    assert [r.line for r in fix_cycle.summary_lines(done.summary).orderBy("at").collect()][0] == "  broken links : 10 found, 6 fixed, 4 remaining"
    again = fix_cycle.repair(done.notes, n.select("path"))
    assert again.rounds == 0 and again.notes.count() == 0


def test_nothing_broken(spark):
    n = spark.createDataFrame([("wiki/a/b.md", "x")], "path string, content string")
    done = fix_cycle.repair(n, n.select("path"))
    assert (done.notes.count(), done.broken.count(), done.summary.count(), done.rounds) == (0, 0, 0, 0)


def test_only_changed_notes_and_new_targets_are_looked_at_again(spark, monkeypatch):
    """One parse of all notes, one of the changed ones; targets of the first round are not looked up again."""
    parsed, asked = [], []
    extract, suggestions = fix_cycle.vault_links.extract, fix_cycle.vault_links.suggestions

    def counted_extract(notes, *args, **kwargs):
        parsed.append(notes.count())
        return extract(notes, *args, **kwargs)

    def counted_suggestions(targets, *args, **kwargs):
        asked.append(sorted(r.target for r in targets.select("target").distinct().collect()))
        return suggestions(targets, *args, **kwargs)

    monkeypatch.setattr(fix_cycle.vault_links, "extract", counted_extract)
    monkeypatch.setattr(fix_cycle.vault_links, "suggestions", counted_suggestions)
    n = spark.createDataFrame(
        [("wiki/a/Two Page.md", "x"), ("wiki/a/One.md", "[[two_page]] [[two_page\\|t]] [[Gone]]"), ("wiki/a/Fine.md", "[[One]]")], "path string, content string"
    )
    done = fix_cycle.repair(n, n.select("path"))
    assert [r.content for r in done.notes.collect()] == ["[[Two Page]] [[two_page\\|t]] [[Gone]]"] and done.rounds == 1
    assert parsed == [3, 1] and asked == [["Gone", "two_page"]]


def test_a_text_is_made_once(spark):
    notes = spark.createDataFrame([("a", "[[b]] [[c]]\n- [[d]]\n![[d]] [[bb]]")], "path string, content string")
    fixes = spark.createDataFrame([("a", "b", "B"), ("a", "c", "C$1"), ("a", "d", None)], "path string, target string, suggested_fix string")
    done = fix_cycle.rewrite.fixed_links(notes, fixes)
    assert [(r.content, r.changes) for r in done.collect()] == [("[[B]] [[C$1]]\n![[d]] [[bb]]", 2)]
    plan = done.select("path", "content")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(gone") == 1
