"""Matching of converted notes against a walk through them in order."""

import random
import re
from pathlib import PurePosixPath as P

from vaultry.operators import conversion


def normal(s):
    return re.sub(r"\s+", " ", re.sub(r"""[_:!#$%&*<>?/\\|'"-]|[^\x00-\x7f]""", " ", s)).strip().lower()


def walked(notes, files):
    """One note after the other, as the rules are written."""
    files, claimed, out = set(files), set(), {}
    order = sorted(notes, key=lambda n: P(n).parts)
    scoped = [n for n in order if P(n).parent.name == "converted" and n.endswith(".md")]

    def near(note):
        parent = P(note).parent.parent
        for folder in (parent, parent / "converted", parent / "_resources"):
            for f in sorted(files, key=lambda f: P(f).name):
                p = P(f)
                if p.parent == folder and p.suffix.lower() != ".md" and p.name != ".DS_Store" and p.suffix.lower() != ".swp":
                    yield p

    for n in scoped:
        p, parent, conv = P(n), P(n).parent.parent, P(n).parent
        m = re.search(r'^source:\s*"?([^"\n]*?)"?\s*$', "\n".join(notes[n].split("\n")[:31]), re.M)
        cands = []
        if m and m[1].strip():
            s = P(m[1].strip())
            cands = [s, parent / s, conv / s, parent / s.name, conv / s.name, parent / "_resources" / s.name]
            cands = [c for c in cands if str(c) in files and c.suffix.lower() != ".md"]
        cands += [c for c in near(n) if p.stem in (c.name, c.stem)]
        out[n] = next((str(c) for c in cands if str(c) not in claimed), None)
        claimed.add(out[n])
    way = {n: "exact" if o else "none" for n, o in out.items()}
    for n in scoped:
        if out[n] is None:
            stem = P(n).stem
            keys = {normal(stem)} | ({normal(P(stem).stem)} if P(stem).suffix else set())
            fit = [str(c) for c in near(n) if str(c) not in claimed and {normal(c.name), normal(c.stem)} & keys]
            if len(set(fit)) == 1:
                out[n], way[n] = fit[0], "fuzzy"
                claimed.add(fit[0])
    return sorted((n, out[n], way[n]) for n in out)


def matched(spark, notes, files):
    n = spark.createDataFrame(list(notes.items()), "path string, content string")
    f = spark.createDataFrame([(x,) for x in files], "path string")
    return sorted(map(tuple, conversion.match(n, f).select("note", "original", "way").collect()))


def test_a_chain_of_rivals(spark):
    """Every note wants what the one before gets, and has one more choice."""
    notes = {f"raw/c/converted/n{i:02}.md": f'---\nsource: "o{max(i - 1, 0):02}.pdf"\n---\n' for i in range(9)}
    files = [f"raw/c/o{i:02}.pdf" for i in range(9)] + [f"raw/c/n{i:02}.docx" for i in range(1, 9, 2)] + [f"raw/c/_resources/o{i:02}.pdf" for i in range(3)]
    want = walked(notes, files)
    assert matched(spark, notes, files) == want
    assert len({o for _, o, _ in want if o}) == sum(o is not None for _, o, _ in want) >= 8


def test_matches_equal_a_walk(spark):
    rng = random.Random(4)
    words = ["a b", "a_b", "A-b", "a b.pdf", "x", "x.y", "é", "z"]
    notes, files = {}, {".DS_Store", "raw/p/.DS_Store", "raw/p/x.swp", "raw/p/x.MD"}
    for parent in ("raw/p", "raw/q", "raw"):
        for w in words:
            if rng.random() < 0.8:
                source = rng.choice(["", "", "x.pdf", "raw/q/a b.docx", "../x.pdf", "sub/a_b.docx", " ", "x.md"])
                notes[f"{parent}/converted/{w}.md"] = f"---\nt: 1\nsource: {source}\n---\nbody"
            for folder in ("", "/converted", "/_resources", "/sub"):
                for ext in (".pdf", ".docx", ""):
                    if rng.random() < 0.08:
                        files.add(f"{parent}{folder}/{w}{ext}")
    notes |= {"raw/p/other/n.md": "source: x.pdf", "converted/top.md": "source: top.txt"}
    notes |= {f"raw/f/converted/{n}.md": "x" for n in ("Big_Report", "Big-Report.pdf", "big report ", "Two_Of.txt", "two-of")}
    files |= {"top.txt", "raw/f/big report.pdf", "raw/f/_resources/two of.pdf", "raw/f/two$of.txt", *notes}
    want = walked(notes, files)
    assert matched(spark, notes, files) == want
    assert {w for *_, w in want} == {"exact", "fuzzy", "none"}


def test_nothing_to_match(spark):
    assert matched(spark, {"raw/a.md": "x"}, ["raw/a.md"]) == []
    assert matched(spark, {"raw/converted/a.md": "x"}, []) == [("raw/converted/a.md", None, "none")]
