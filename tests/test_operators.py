"""Operators on small vaults, against expected rows or brute force."""

import json
import re

import pytest
from pyspark.sql import functions as F

from vaultry.operators import (
    doctor, freshness, ingest, inventory, ledger, page_checks, privacy, provenance, relocation, rewrite,
    retrieval, stamping, supersession, transcripts, vault_links,
)
from vaultry.sinks import files as file_sink
from vaultry.sources import ledger as log_source
from vaultry.sources import vault
from vaultry.streaming import ingest as stream


def notes(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "path string, content string")


def table(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


PAGE = """---
title: "My Page"
---
# Top

## Sec
line ^b1
second ^b2

```
code ^b9
```
#### Deep
multi
line ^b3 ^b4
### Next ##
text ^b1

> [!provenance]- x
> schema: kb-prov-v1
> blocks:
>   b1:
>     status: current
>     sources: [raw/a.md]
>     observed: 2024-05-01
>     checked: 2024-04-01
>   b3:
>     status: superseded
> other: 1
>   b4:
>     status: current
"""


def test_blocks_and_issues(spark):
    df = notes(spark, **{"wiki/concepts/p.md": PAGE})
    blocks = inventory.index_blocks(df).orderBy("ordinal").collect()
    assert [(b["id"], b["text"], b["heading_path"], b["status"]) for b in blocks] == [
        ("b1", "line", ["Top", "Sec"], "current"), ("b2", "second", ["Top", "Sec"], "unknown"),
        ("b9", "```\ncode", ["Top", "Sec"], "unknown"), ("b3", "multi\nline", ["Top", "Sec", "Deep"], "superseded"),
        ("b4", "multi\nline", ["Top", "Sec", "Deep"], "unknown"), ("b1", "text", ["Top", "Sec", "Next"], "current"),
    ]
    found = {(i["code"], i["block_id"]) for i in provenance.validate(df).collect()}
    assert found == {("duplicate-block-id", "b1"), ("date-order", "b1"), ("missing-sources", "b3"), ("missing-superseded-by", "b3")}


def test_ranking_ties(spark):
    ddl = ("path string, ordinal int, id string, status string, confidence string, observed string, checked string, "
           "provenance_quality string, superseded_by string, evidence_latest string, review_mode string")
    rows = [("wiki/a/x.md", i, id_, st, conf, None, chk, None, None, None, None) for i, (id_, st, conf, chk) in enumerate([
        ("old", "superseded", "high", "2024-09-01"), ("b", "current", "low", "2024-01-20"), ("a", "current", "low", "2024-01-02"),
        ("new", "current", "low", "2024-02-01"), ("none", "current", "low", None), ("odd", "disputed", "high", "2024-09-01")])]
    df = table(spark, rows, ddl)
    ranked = [r["id"] for r in freshness.rank(df, "what is current?").orderBy("rank").collect()]
    assert ranked == ["new", "a", "b", "none", "odd", "old"]
    assert freshness.rank(df, "now", limit=0).count() == 0
    with pytest.raises(FileNotFoundError, match="wiki/no.md"):
        freshness.selected_pages(df.select("path"), table(spark, [(0, "[[wiki/no|x]]")], "ordinal int, page string"))


def test_privacy_closures_differ(spark):
    df = notes(spark, **{
        "raw/n/a.md": "---\ningest: false\nsource: b.pdf\n---\n![[pic.pdf]] [x](../o/c.md#h) [[d]] [[https://x]]",
        "raw/n/ok.md": "no ingest flag"})
    files = [("raw/n/a.md",), ("raw/n/ok.md",), ("raw/n/b.pdf",), ("raw/n/_resources/pic.pdf",), ("raw/o/c.md",), ("raw/n/d.txt",)]
    candidates = table(spark, files, "path string")
    note = privacy.protected_notes(df)
    relative = {r["path"] for r in privacy.closure_relative(note, candidates).collect()}
    by_name = {r["path"] for r in privacy.closure_by_name(note, candidates).collect()}
    assert by_name == {r["path"] for r in privacy.protected_by_name(note, candidates).collect()}
    assert relative == {"raw/n/a.md", "raw/n/b.pdf", "raw/o/c.md", "raw/n/d.txt"}
    assert by_name == {"raw/n/a.md", "raw/n/b.pdf", "raw/n/_resources/pic.pdf", "raw/o/c.md"}


def log_rows(spark, *lines):
    text = [(i, l if isinstance(l, str) else json.dumps(l)) for i, l in enumerate(lines)]
    return log_source.parse_lines(table(spark, text, "line_no bigint, value string"))


def test_prune_is_idempotent_and_merges(spark):
    log = log_rows(
        spark, {"file": "raw/a.md", "date": "2", "pages_created": ["x", "x"], "k": {"z": 1}}, "{bad", "",
        {"file": "raw/a.md", "date": "1", "pages_created": ["y", "x"]}, {"file": "raw/gone.md"}, {"date": "3"},
        {"file": "raw/b.md", "pages_updated": ["p", "p"]}, {"file": "raw/c.md", "pages_created": None, "mtime": "7", "hash": 5},
    )
    files = table(spark, [("raw/a.md",), ("raw/b.md",), ("raw/c.md",)], "path string")
    kept = {r["file"]: r for r in ledger.prune(log, files).collect()}
    assert kept["raw/a.md"]["pages_created"] == ["x", "y"] and kept["raw/a.md"]["date"] == "2"
    assert kept["raw/b.md"]["pages_updated"] == ["p", "p"] and kept["raw/b.md"]["pages_created"] is None
    assert kept["raw/c.md"]["pages_created"] == [] and kept["raw/c.md"]["mtime"] is None and kept["raw/c.md"]["hash"] is None
    assert ledger.prune_counts(log, files).first().asDict() == {"kept": 3, "dropped": 2, "malformed": 1, "duplicates": 1}


def test_updated_lines_keep_unknown_keys(spark):
    line = table(spark, [('{"b": {"q": [1, 2]}, "file": "old", "n": 1.5}',)], "raw string")
    got = line.select(log_source.updated_line(F.col("raw"), {"file": F.lit("new"), "mtime": F.lit(3).cast("bigint"), "hash": F.lit(None).cast("string")})).first()[0]
    assert json.loads(got) == {"b": {"q": [1, 2]}, "file": "new", "n": 1.5, "mtime": 3}


def test_relink(spark):
    log = log_rows(spark, *[{"file": f, "hash": h} for f, h in [
        ("raw/old1.md", "A"), ("raw/old2.md", "A"), ("raw/kept.md", "B"), ("raw/lost.md", "C"), ("raw/twin.md", "D")]])
    files = table(spark, [("raw/new.md", "A", 9), ("raw/kept.md", "B", 1), ("raw/copy.md", "B", 1), ("raw/d1.md", "D", 1), ("raw/d2.md", "D", 1), ("wiki/x.md", "C", 1)],
                  "path string, hash string, mtime bigint")
    got = {r["file"]: (r["outcome"], r["new_file"]) for r in ledger.relink(log, files).collect()}
    assert got == {"raw/old1.md": ("relinked", "raw/new.md"), "raw/old2.md": ("claimed", None), "raw/lost.md": ("missing", None), "raw/twin.md": ("ambiguous", None)}


def test_ingest_cascade(spark):
    content = {"same": "s", "touched": "t", "renamed": "r", "modified": "m2", "new": "n", "unhashed": "u"}
    h = {k: "sha256:" + __import__("hashlib").sha256(v.encode()).hexdigest() for k, v in {**content, "modified": "m1"}.items()}
    files = table(spark, [(f"raw/{k}.md", 5, v) for k, v in content.items()], "path string, mtime bigint, content string")
    log = table(spark, [("raw/same.md", h["same"], 5), ("raw/touched.md", h["touched"], 4), ("raw/before.md", h["renamed"], 4),
                        ("raw/modified.md", h["modified"], 4), ("raw/unhashed.md", None, None)], "file string, hash string, mtime bigint")
    nobody = table(spark, [], "path string")
    assert {r["path"] for r in ingest.new_files(files, log, nobody, nobody).collect()} == {"raw/modified.md", "raw/new.md"}


LINKS = [("[[Note]]", True), ("[[wiki/a/Note]]", True), ("[[a/Note.md]]", True), ("[[wiki/a]]", True), ("[[v1.2]]", True), ("[[pic.png]]", True),
         ("[[_res/pic.png]]", True), ("[[./Note]]", True), ("[[Missing]]", False), ("[[x/Note]]", False), ("[[No-te]]", False), ("[[It’s]]", True),
         ("[m](Note.md)", True), ("[m](../raw/v1.2)", False), ("[m](../../raw/v1.2)", True), ("[m](wiki/a/Note)", True), ("[m](No%20te.md)", True)]


def test_link_resolution(spark):
    paths_ = ["wiki/a/Note.md", "wiki/a/No te.md", "raw/v1.2.md", "raw/_res/pic.png", "wiki/a/It's.md", "wiki/index.md"]
    files = table(spark, [(p,) for p in paths_], "path string")
    df = notes(spark, **{"wiki/a/Note.md": "\n".join(l for l, _ in LINKS)})
    broken = vault_links.broken(vault_links.extract(df, True), files)
    assert {r["line"] for r in broken.collect()} == {i for i, (_, ok) in enumerate(LINKS, 1) if not ok}
    fixes = vault_links.suggestions(table(spark, [("No-te",), ("a/No_te",), ("wiki/a/No_te",), ("Note .md",), ("_res/pic .png",), ("zz",)], "target string"), files)
    assert {r["target"]: r["suggested_fix"] for r in fixes.collect()} == {
        "No-te": "No te", "wiki/a/No_te": "wiki/a/No te", "_res/pic .png": "_res/pic.png", "Note .md": "Note"}


def test_doctor(spark):
    df = notes(spark, **{
        "wiki/a/One.md": "---\nx: [[Two]]\n---\n# One\nenough words to be no stub here", "wiki/a/Two.md": "# Two\nshort",
        "wiki/a/Alone.md": "---\nstub: true\n---\nx", "wiki/a/Exempt.md": "---\norphan: false\n---\n- [[link]]\nfive words are in here", "wiki/index.md": "[[Alone]]"})
    files = df.select("path").union(table(spark, [("raw/x.pdf",), ("raw/converted/y.md",), ("raw/_resources/z.pdf",)], "path string"))
    out = doctor.check(df, files)
    assert {r["path"] for r in out["orphans"].collect()} == {"wiki/a/Alone.md"}
    assert {r["path"] for r in out["stubs"].collect()} == {"wiki/a/Two.md"}
    assert {r["path"] for r in out["loose_files"].collect()} == {"raw/x.pdf"}
    assert out["legacy_folders"].first().asDict() == {"folder": "raw/converted", "md_files": 1}
    assert doctor.summary(df, out["links"], out["broken_links"]).first().asDict() == {"files_checked": 4, "links_checked": 2, "broken": 1, "skipped_external": 0}


def test_text_mentions_equal_brute_force(spark):
    stems = ["foo bar", "foo", "x(y)", "(z", "a.b", "é è", "v1.2", "end)", "no-go"]
    texts = ["foo  bar", "a foo bar.md b", "foobar foo", "x(y) x(y)z", "((z (z", "a.b a.bc", "é è", "v1.2.md", "end).md end)x", "no-go", "(end)", "xfoo bar", "q(z", ""]
    got = page_checks.text_mentions(table(spark, [(s,) for s in stems], "stem string"), table(spark, [(str(i), t) for i, t in enumerate(texts)], "path string, content string"))
    expected = {(s, str(i)) for s in stems for i, t in enumerate(texts) if re.search(r"(?<!\w)" + re.escape(s) + r"(?:\.md)?(?!\w)", t)}
    assert {(r["stem"], r["path"]) for r in got.collect()} == expected


def test_paragraphs_equal_a_loop(spark):
    texts = ["One", "two.", "Three.", "x" * 490 + ".", "four.", "Five", "six."]
    cues = [("f", i, i * 2.0 + (10 if i > 4 else 0), i * 2.0 + 1 + (10 if i > 4 else 0), "A", t) for i, t in enumerate(texts)]
    rows = transcripts.paragraph_rows(table(spark, cues, "file string, pos bigint, start double, end double, speaker string, text string"))
    by_row = [r["paragraph"] for r in rows.orderBy("block", "at").collect()]
    got = transcripts.blocks(table(spark, cues, "file string, pos bigint, start double, end double, speaker string, text string")).first()["paragraphs"]
    expected, current, end = [], cues[0][5], cues[0][3]
    for _, _, start, stop, _, words in cues[1:]:
        merged = f"{current} {words}"
        if not current.endswith(".") or (start - end < 3.0 and len(merged) <= 500):
            current = merged
        else:
            expected.append(current)
            current = words
        end = stop
    assert got == by_row == [*expected, current]


def test_rewrites(spark):
    def run(fn, content):
        return table(spark, [(content,)], "c string").select(fn(F.col("c"))).first()[0]

    t = F.lit("a+b")
    assert run(lambda c: rewrite.deleted_wikilink(c, t), "x [[a+b]] y\r\n- [[a+b|z]]\r\n\"[[a+b]]\"\nend") == "x y\r\nend"
    assert run(lambda c: rewrite.deleted_mdlink(c, t, True), "![p](a+b#x)\nq ![p](a+b) r") == "q r"
    assert run(lambda c: rewrite.delinked_wikilink(c, F.lit("x/y.gpx"), True), "![[x/y.gpx]]") == "y.gpx"
    assert run(lambda c: rewrite.replaced_mdlink(c, t, F.lit("$n")), "[q](a+b #h) ![q](a+b)") == "[q]($n) ![q](a+b)"
    assert run(lambda c: rewrite.marked_broken(c, t), "[[a+b#h\\|t]]") == "[[a+b#h|(broken link) t]]"
    assert run(rewrite.straightened_links, "“q” [[it’s|“x”]] ![[‘y’]] [t](a’b) [u](https://x’y)") == "“q” [[it's|“x”]] ![['y']] [t](a'b) [u](https://x’y)"
    linked = run(lambda c: rewrite.plain_references_linked(c, F.lit("Big Plan")), "---\nt: Big Plan\n---\nBig Plan.md and [[Big Plan]] `Big Plan` [Big Plan](x) Big Plans Big Plan")
    assert linked == "---\nt: Big Plan\n---\n[[Big Plan]] and [[Big Plan]] `Big Plan` [Big Plan](x) Big Plans [[Big Plan]]"
    keyed = run(lambda c: rewrite.with_key(c, "orphan", "false"), "---\na: b\n---\nx")
    assert keyed == "---\na: b\norphan: false\n---\nx"
    assert run(lambda c: rewrite.without_key(c, "orphan", "false"), keyed) == "---\na: b\n---\nx"
    assert run(lambda c: rewrite.with_key(c, "orphan", "false"), "x") == "---\norphan: false\n---\nx"
    assert run(lambda c: rewrite.with_key(c, "orphan", "false"), "---\na: b") == "---\na: b"


def test_stamp_is_refused_twice(spark):
    spec = stamping.specs(table(spark, [("wiki/a/p.md", "odd", None, "", ["raw/x.md"], None, None), ("../x.md", None, None, None, None, None, None), ("wiki/no.md", None, None, None, None, None, None)],
                                "page string, stamp_mode string, mode string, reason string, sources array<string>, related_raw array<string>, latest_related_raw_date string"))
    page = notes(spark, **{"wiki/a/p.md": "# P\nbody"})
    first = {r["page"]: r for r in stamping.stamp(spec, page, "2024-01-01").collect()}
    assert (first["../x.md"]["action"], first["wiki/no.md"]["action"], first["wiki/a/p.md"]["mode"]) == ("skipped", "missing", "historical")
    stamped = notes(spark, **{"wiki/a/p.md": first["wiki/a/p.md"]["content"]})
    assert provenance.validate(stamped).count() == 0
    assert inventory.index_blocks(stamped).first()["provenance_quality"] == "minimal-risk-stamp"
    again = {r["page"]: r["outcome_reason"] for r in stamping.stamp(spec, stamped, "2024-01-01").collect()}
    assert again["wiki/a/p.md"] == "page already has provenance"


def test_manifest_forms(spark, tmp_path):
    for body in ('[{"page": "p", "mode": "manual-review"}, {"x": 1}]', '{"auto_ok": [{"page": "p", "mode": "manual-review"}]}'):
        path = tmp_path / "m.json"
        path.write_text(body)
        assert [r["mode"] for r in stamping.read_specs(spark, str(path)).collect()] == ["manual-review"]


def test_vault_source_and_plan(spark, tmp_path):
    for name, data in {"wiki/a/_index.md": b"i", "wiki/a/p.md": b"old", "raw/x/_resources/f #1.pdf": b"\xff", ".git/x": b"", "raw/.h/y.md": b"", "top.md": b"t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = vault.read(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"wiki/a/_index.md", "wiki/a/p.md", "raw/x/_resources/f #1.pdf", "top.md"}
    assert vault.as_text(files, strict=True).count() == 3
    plan = rewrite.plan(vault.as_text(files).where("path = 'wiki/a/p.md'"), F.lit("new"))
    assert [r["outcome"] for r in file_sink.apply(plan, str(tmp_path), dry_run=True).collect()] == ["written"]
    rows = spark.createDataFrame([tuple(r) for r in plan.collect()], plan.schema)
    assert [r["outcome"] for r in file_sink.apply(rows, str(tmp_path)).collect()] == ["written"]
    assert (tmp_path / "wiki/a/p.md").read_text() == "new"
    assert [r["outcome"] for r in file_sink.apply(rows, str(tmp_path)).collect()] == ["done"]


def test_stream_skips_renamed_files(spark, tmp_path):
    ddl = "path string, mtime bigint, content string"
    (tmp_path / "in").mkdir()

    def feed(n, rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"d={n}"))
        source = spark.readStream.schema(ddl).parquet(str(tmp_path / "in" / "d=*"))
        stream.start(source, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
        return {r["file"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}

    assert feed(1, [("raw/a.md", 1, "A")]) == {"raw/a.md"}
    assert feed(2, [("raw/renamed.md", 2, "A"), ("raw/a.md", 3, "A2"), ("raw/b.md", 1, "B")]) == {"raw/a.md", "raw/b.md"}


def test_safe_raw_names(spark):
    files = table(spark, [("raw/a b.md",), ("raw/a#b.md",), ("raw/a&b.md",), ("raw/x .md",), ("raw/x.md",)], "path string")
    got = {r["old"]: r["new"] for r in relocation.safe_names(files).collect()}
    assert got == {"raw/a#b.md": "raw/a_b.md", "raw/a&b.md": "raw/a_b 2.md", "raw/x .md": "raw/x 2.md"}


def test_joins_of_a_hot_key_keep_every_row(spark):
    """A key that holds half the rows, in the joins that adaptive execution splits."""
    log = spark.range(4000).select(
        F.col("id").alias("line_no"), F.when(F.col("id") % 2 == 0, "raw/hot.md").otherwise(F.concat(F.lit("raw/n"), F.col("id"), F.lit(".md"))).alias("file"),
        F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("mtime"), F.lit(False).alias("malformed"),
    )
    files = spark.createDataFrame([("raw/hot.md", "sha256:1", 5), ("raw/n1.md", "sha256:2", 6)], "path string, hash string, mtime long")
    out = ledger.stamp(log, files)
    assert out.count() == 4000 and out.where("stamped").count() == 2001


def ring(n):
    return [(f"wiki/a/p{i:03}.md", 0, f"wiki/a/p{(i + 1) % n:03}.md", f"wiki/a/p{(i + 1) % n:03}.md", "resolved") for i in range(n)]


def test_rings_of_any_length_are_found(spark):
    rows = ring(60) + [("wiki/b/lead.md", 0, "wiki/a/p000.md", "wiki/a/p000.md", "resolved"), ("wiki/c/x.md", 0, "wiki/c/y.md", "wiki/c/y.md", "resolved")]
    edges = spark.createDataFrame(rows, "path string, position int, target string, resolved string, outcome string")
    got = {r["path"]: r["cycle"].split(" -> ") for r in supersession.cycles(edges).collect()}
    assert len(got) == 61
    assert all(len(c) == 61 and c[0] == c[-1] == p for p, c in got.items() if p.startswith("wiki/a/"))
    assert got["wiki/b/lead.md"][1] == got["wiki/b/lead.md"][-1] == "wiki/a/p000.md"
    short = supersession.cycles(edges, max_chain=50).collect()
    assert len(short) == 61 and all(r["truncated"] and r["cycle"] is None for r in short)


def test_numbers_of_moved_and_renamed_files_have_no_end(spark):
    there = [f"raw/c/_resources/a{'' if i == 1 else f' {i}'}.pdf" for i in range(1, 151) if i != 120]
    files = spark.createDataFrame([(p,) for p in ["raw/c/a.pdf", "raw/c/b 7.pdf", *there]], "path string")
    moves = relocation.loose_file_moves(files.where("path LIKE 'raw/c/_.pdf' OR path LIKE 'raw/c/b%'"), files)
    assert {r["old"]: r["new"] for r in moves.collect()} == {
        "raw/c/a.pdf": "raw/c/_resources/a 120.pdf", "raw/c/b 7.pdf": "raw/c/_resources/b 7.pdf"}
    odd = [f"raw/x/n{c}.md" for c in "!$&*"] + [f"raw/x/n{i * chr(33)}_2.md" for i in (1, 2)]
    files = spark.createDataFrame([(p,) for p in [*odd, "raw/x/n.md", "raw/x/n 3.md"]], "path string")
    new = [r["new"] for r in relocation.safe_names(files).collect()]
    taken = {r["path"] for r in files.collect()}
    assert len(new) == len(set(new)) and not set(new) & taken


def test_rewrites_take_time_in_proportion_to_lines(spark):
    import time

    def seconds(n):
        page = "---\na: b\n---\n# T\n" + "\n".join(f"line {i} Big Plan raw/x.md `raw/a {i}.md`" for i in range(n))
        spec = stamping.specs(table(spark, [("wiki/a/p.md", "odd", None, "", None, None, None)],
                                    "page string, stamp_mode string, mode string, reason string, sources array<string>, related_raw array<string>, latest_related_raw_date string"))
        pages = notes(spark, **{"wiki/a/p.md": page})
        start = time.perf_counter()
        stamping.stamp(spec, pages, "2024-01-01").collect()
        pages.select(rewrite.wrapped_raw_references(F.col("content")), rewrite.plain_references_linked(F.col("content"), F.lit("Big Plan"))).collect()
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(1000), seconds(8000)
    assert large < 8 * small + 5


def test_fences_of_either_character(spark):
    text = "raw/a.md\n- raw/a.md\n~~~\n- raw/b.md\n```\n- raw/c.md\n~~~\n- raw/d.md\n```\n- raw/e.md"
    got = table(spark, [(text,)], "c string").select(rewrite.wrapped_raw_references(F.col("c")).alias("c")).first()["c"]
    assert got == text.replace("raw/a.md\n~~~", "[[raw/a.md]]\n~~~").replace("- raw/d.md", "- [[raw/d.md]]")


def test_log_order_follows_the_arguments(spark, tmp_path):
    from vaultry.sources import ledger as source

    (tmp_path / "z.jsonl").write_text("".join(f'{{"date":"2024","file":"raw/n.md","summary":"z{i}"}}\n' for i in range(50)))
    (tmp_path / "a.jsonl").write_text('{"date":"2024","file":"raw/n.md","summary":"first","summary":"last"}\n' + "x" * 5000 + "\n")
    rows = source.read(spark, str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")).where("NOT malformed").orderBy("line_no").collect()
    assert [r["summary"] for r in rows] == [f"z{i}" for i in range(50)] + ["last"]
    best = ledger.prune(source.read(spark, str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")), table(spark, [("raw/n.md",)], "path string"))
    assert [r["summary"] for r in best.collect()] == ["last"]


def test_questions_are_read_like_texts(spark):
    texts = table(spark, [(1, "the current state, now"), (2, "nothing here")], "k int, t string")
    assert [r["k"] for r in retrieval.bm25(texts, "k", "t", "What is the STATE?").collect()] == [1]
