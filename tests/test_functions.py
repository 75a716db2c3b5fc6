"""Scalar rules, from decision tables."""

import pytest
from pyspark.sql import functions as F

from vaultry.functions import dates, frontmatter, links, names, paths, ranking, text
from vaultry.operators import mail, provenance, topics


def value(spark, fn, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"a{i} string" for i in range(len(args))))
    return row.select(fn(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize("question, intent", [
    ("what is it now", "current"), ("", "current"), ("who WAS in charge", "history"), ("wash", "current"),
    ("how did it change since it was new", "change"), ("over time", "change"), ("exchange", "current"),
])
def test_intent(spark, question, intent):
    assert value(spark, ranking.query_intent, question) == intent


@pytest.mark.parametrize("status, confidence, intent, score", [
    ("current", "high", "current", 100), ("superseded", "medium", "current", -60), (None, None, "current", 20),
    ("historical", "low", "history", 70), ("stale", "odd", "change", 35), ("nonsense", "high", "history", 20),
])
def test_score(spark, status, confidence, intent, score):
    assert value(spark, ranking.score, status, confidence, intent) == score


@pytest.mark.parametrize("checked, month", [("2024-05-30", 24293), ("2024-5-3T10", 0), ("soon", 0), (None, 0)])
def test_check_month(spark, checked, month):
    assert value(spark, ranking.check_month, checked) == month


@pytest.mark.parametrize("raw, items", [
    ("[]", []), ("[ ]", []), ("[raw/a, b.md, raw/c.md]", ["raw/a, b.md", "raw/c.md"]), ("[one, two]", ["one", "two"]),
    ('["raw/q, z.md", raw/y.md]', ["raw/q, z.md", "raw/y.md"]), ("[slack:1, https://x/y, z]", ["slack:1", "https://x/y, z"]),
    ("[plain, raw/a, tail, ./b]", ["plain", "raw/a, tail", "./b"]), ("plain", None),
])
def test_source_items(spark, raw, items):
    assert value(spark, provenance.source_items, raw) == items


@pytest.mark.parametrize("raw, items", [('["a, b", c]', ["a, b", "c"]), ('["say ""x""", y]', ['say "x"', "y"]), ("[a,,b]", ["a", "", "b"])])
def test_list_items(spark, raw, items):
    assert value(spark, provenance.list_items, raw) == items


@pytest.mark.parametrize("raw, scalar", [("null", None), ("~", None), (" None ", None), ("'x'", "x"), ('"x', '"x'), ("x y", "x y")])
def test_scalar(spark, raw, scalar):
    assert value(spark, provenance.scalar, raw) == scalar


@pytest.mark.parametrize("name, key", [
    ("foo_ bar", "foo bar"), ("Foo-Bar-Baz", "foo bar baz"), ("café’s “x”", "caf s x"), ("a#1: b?", "a 1 b"), ("___", ""),
])
def test_fuzzy_name(spark, name, key):
    assert value(spark, names.fuzzy_name, name) == key


def test_title_variants(spark):
    got = value(spark, names.title_variants, "2024-01-02 Mail - Part - 7.tar.docx")
    assert got[0] == "2024-01-02 Mail - Part - 7.tar.docx"
    assert {"Mail - Part - 7.tar", "Part - 7.tar.docx", "7.tar"} <= set(got)


@pytest.mark.parametrize("path, stem, suffix", [
    ("a/b.md", "b", ".md"), ("v1.2", "v1", ".2"), (".hidden", ".hidden", ""), ("x.", "x.", ""), ("a.b/c", "c", ""), ("..a", ".", ".a"),
])
def test_path_parts(spark, path, stem, suffix):
    assert value(spark, lambda p: F.array(paths.stem(p), paths.suffix(p)), path) == [stem, suffix]


@pytest.mark.parametrize("path, result", [("a//b/./c/", "a/b/c"), ("a/../b", "b"), ("../a", None), ("a/b", "a/b"), ("./x", "x")])
def test_resolved(spark, path, result):
    assert value(spark, paths.resolved, path) == result


@pytest.mark.parametrize("given, decoded", [("a%20b+c", "a b+c"), ("100%", "100%"), ("%zz%41", "%zzA")])
def test_url_decoding(spark, given, decoded):
    assert value(spark, paths.url_decoded, given) == decoded


@pytest.mark.parametrize("content, lines", [("", []), ("a\n", ["a"]), ("a\r\nb c\x0bd", ["a", "b", "c", "d"]), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(spark, content, lines):
    assert value(spark, text.lines, content) == lines == content.splitlines()


@pytest.mark.parametrize("target, cleaned", [
    ("<a b.md>", "a b.md"), ("'x.md'", "x.md"), ("a%20b.md#h", "a b.md"), ("https://x", None), ("#h", None), ("a\\b?q", "a/b"), (" ", None),
])
def test_cleaned_target(spark, target, cleaned):
    assert value(spark, links.cleaned_target, target) == cleaned


def test_link_extraction(spark):
    line = "a [[x [1] y|al]] ![[i.png]] [t](f_(m).res/x#h) ![p](q.png) [[gone|(broken link) z]] [[t\\|c]]"
    got = value(spark, lambda c: links.in_lines(text.lines(c), True), line)
    assert [(l["type"], l["target"]) for l in got] == [
        ("wikilink", "x [1] y"), ("wikilink", "t"), ("image", "i.png"), ("markdown", "f_(m).res/x"), ("image", "q.png"),
    ]


def test_long_unclosed_link_does_not_overflow(spark):
    line = "[[" + "ab\\x" * 60_000
    assert len(value(spark, lambda c: links.in_lines(text.lines(c), True), line)) == 1


@pytest.mark.parametrize("content, found", [
    ("---\ningest: false\n---\nx", True), ("---\nINGEST : 'False' # no\n...\n", True), ("---\ningest: no\n---\n", False),
    ("---\ningest: false\n", False), ("x\n---\ningest: false\n---\n", False),
])
def test_ingest_false(spark, content, found):
    assert value(spark, lambda c: frontmatter.says_ingest_false(frontmatter.closed_lines(text.lines(c))), content) is found


def test_front_matter_readings_differ(spark):
    unclosed = "---\norphan: false\ntext"
    assert value(spark, lambda c: frontmatter.has_flag(text.lines(c), "orphan", "false"), unclosed) is True
    assert value(spark, lambda c: frontmatter.closed_lines(text.lines(c)), unclosed) == []
    entries = value(spark, frontmatter.inventory_map, "---\na: 1\n# x: 2\na: '3'\nb:c:d\n---\nbody")
    assert entries == {"a": "3", "b": "c:d"}
    assert value(spark, lambda c: frontmatter.dates_value(text.lines(frontmatter.dates_block(c)), "date"), "---\nDate: \"x\"\n---y") == '"x"'


@pytest.mark.parametrize("given, date, grain", [
    ("on 2024-03-14.", "2024-03-14", "day"), ("Sept. 2020", "2020-09-01", "month"), ("TASK-196636", None, None), ("of 2021_x", "2021-07-01", "year"),
])
def test_normal_date(spark, given, date, grain):
    got = value(spark, dates.normal, given)
    assert (got["date"], got["grain"]) == (date, grain) if date else got is None


@pytest.mark.parametrize("path, date, span", [
    ("x/2020–2023 plan.md", "2023-07-01", "2020–2023"), ("2024-03-14_n.md", "2024-03-14", "2024"),
    ("n 14-03-2024.md", "2024-03-14", "2024"), ("May 2019.md", "2019-05-01", "2019"), ("plain.md", None, None),
])
def test_file_name_date(spark, path, date, span):
    got = value(spark, dates.from_file_name, path)
    assert (got["date"], got["span"], got["confidence"]) == (date, span, "high") if date else got is None


@pytest.mark.parametrize("path, key", [
    ("raw/2014-06-01_F.resources/x.pdf", "2014-06-01T23:59:59"), ("raw/2014 a/2015-02 b.md", "2015-02-31T23:59:59"),
    ("raw/x.md", "1970-01-01T00:01:40"), ("raw/20141.md", "1970-01-01T00:01:40"),
])
def test_ingest_order(spark, path, key):
    assert value(spark, lambda p: dates.ingest_order_key(p, F.lit(100)), path) == key


def test_safe_names_and_spelling(spark):
    assert value(spark, names.shell_safe_name, "it's é #1 .tar .md") == "it_s _ _1 .tar.md"
    assert value(spark, names.file_name_safe, "“a” – b…​ → é") == '"a" - b... -> é'
    assert value(spark, mail.addresses, " a; b ;; c") == "a, b, c"
    assert value(spark, lambda p: paths.truncated(p), "a" * 30 + "b" * 30) == "a" * 20 + "..." + "b" * 17


def test_index_summary(spark):
    got = value(spark, lambda p, c: topics.title_and_summary(p, text.lines(c)), "wiki/a/b.md", "## T\n\n### U\nOne. Two.")
    assert (got["title"], got["summary"]) == ("T", "One.")
