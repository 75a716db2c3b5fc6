"""Converted notes and the originals they were made from.

Every note in a ``converted`` folder may claim one original and no original is claimed twice; notes come in scan order.  Instead of walking
through them one by one, rounds settle all notes that no earlier one can get in the way of: in the first pass a note takes its best free
candidate, in the second the only one whose normalised name fits.  The number of rounds is that of rivals in a row, not of notes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths, text
from ..session import checkpointed
from .mail import text_callout

# The line that names a note's source, the lines it is looked for in, and files that are no originals.
_SOURCE = r"""\Asource:\s*"?([^"\n]*?)"?\s*\z"""
_SOURCE_LINES = 31
_JUNK_NAME, _JUNK_SUFFIX = ".DS_Store", ".swp"


def converted_notes(notes: DataFrame) -> DataFrame:
    """Notes (path, content) that lie directly in a ``converted`` folder: note, parent, stem, source, order."""
    path, folder = F.col("path"), paths.parent(F.col("path"))
    head = F.slice(text.lines(F.col("content")), 1, _SOURCE_LINES)
    named = F.transform(head, lambda l: text.strip(F.regexp_extract(F.rtrim(l), _SOURCE, 1)))
    return notes.where(path.endswith(".md") & (paths.name(folder) == "converted")).select(
        path.alias("note"), paths.parent(folder).alias("parent"), paths.stem(path).alias("stem"),
        F.get(F.filter(named, lambda s: s != ""), F.lit(0)).alias("source"), paths.component_order(path).alias("order"),
    )


def _within(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _nearby(files: DataFrame) -> DataFrame:
    """Files that may be originals of notes in ``parent/converted``: original, parent, place, name."""
    path, folder = F.col("path"), paths.parent(F.col("path"))
    usable = files.where(
        (F.lower(paths.suffix(path)) != ".md") & (paths.name(path) != _JUNK_NAME) & (F.lower(paths.suffix(path)) != _JUNK_SUFFIX)
    )
    last = paths.name(folder)
    # a file is near the notes of the folder it lies in, and of the folder above converted/ and _resources/
    at = F.array(
        F.struct(folder.alias("parent"), F.lit(0).alias("place")),
        F.when(last == "converted", F.struct(paths.parent(folder).alias("parent"), F.lit(1).alias("place"))),
        F.when(last == "_resources", F.struct(paths.parent(folder).alias("parent"), F.lit(2).alias("place"))),
    )
    return usable.select(path.alias("original"), paths.name(path).alias("name"), F.explode(F.filter(at, lambda x: x.isNotNull())).alias("_at")).select(
        "original", "_at.parent", "_at.place", "name"
    )


def exact_candidates(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Originals by source line or name, best first: note, order, rank, original.  ``notes`` as of :func:`converted_notes`."""
    parent, source = F.col("parent"), F.col("source")
    inside = _within(parent, F.lit("converted"))
    told = F.array(
        source, _within(parent, source), _within(inside, source), _within(parent, paths.name(source)),
        _within(inside, paths.name(source)), _within(_within(parent, F.lit("_resources")), paths.name(source)),
    )
    by_source = notes.where(source.isNotNull() & ~source.startswith("/")).select("note", "order", F.posexplode(told).alias("way", "_path")).select(
        "note", "order", F.struct("way", F.lit("").alias("name")).alias("rank"), paths.resolved(F.col("_path")).alias("original")
    )
    originals = files.where(F.lower(paths.suffix(F.col("path"))) != ".md").select(F.col("path").alias("original"))
    near = _nearby(files)
    keyed = near.select("*", F.explode(F.array_distinct(F.array("name", paths.stem(F.col("name"))))).alias("stem"))
    by_name = notes.join(keyed, ["parent", "stem"]).select(
        "note", "order", F.struct((F.lit(6) + F.col("place")).alias("way"), "name").alias("rank"), "original"
    )
    found = by_source.join(originals, "original", "left_semi").select("note", "order", "rank", "original").unionByName(by_name)
    return found.groupBy("note", "order", "original").agg(F.min("rank").alias("rank"))


def fuzzy_candidates(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Originals whose normalised name or stem is that of the note, with and without an inner extension: note, order, original."""
    stem, name = F.col("stem"), F.col("name")
    own = F.when(paths.suffix(stem) != "", names.fuzzy_name(paths.stem(stem)))
    keys = notes.select("note", "order", "parent", F.explode(F.array_distinct(F.array_compact(F.array(names.fuzzy_name(stem), own)))).alias("key"))
    near = _nearby(files).select(
        "original", "parent", F.explode(F.array_distinct(F.array(names.fuzzy_name(name), names.fuzzy_name(paths.stem(name))))).alias("key")
    )
    return keys.join(near, ["parent", "key"]).select("note", "order", "original").distinct()


def _settled(pairs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Assignments (note, original) by rounds over ``pairs`` (note, order, original, ...).

    ``decide`` gets every pair with ``first``, whether no earlier note that is still open has its original among its candidates, and
    returns the notes that are done: note, original (NULL for none).
    """
    done: list[DataFrame] = []
    left = checkpointed(pairs)
    while not left.isEmpty():
        earliest = left.groupBy("original").agg(F.min("order").alias("_earliest"))
        round_ = checkpointed(decide(left.join(earliest, "original").withColumn("first", F.col("order") == F.col("_earliest"))))
        done.append(round_.where("original IS NOT NULL"))
        left = checkpointed(
            left.join(round_.select("note"), "note", "left_anti")
            .join(done[-1].select("original"), "original", "left_anti").select(pairs.columns)
        )
    out = done[0] if done else pairs.select("note", "original")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _best_free(pairs: DataFrame) -> DataFrame:
    """Notes whose best candidate is theirs."""
    best = pairs.groupBy("note").agg(F.min_by(F.struct("original", "first"), F.col("rank")).alias("b"))
    return best.where("b.first").select("note", "b.original")


def _only_free(pairs: DataFrame) -> DataFrame:
    """Notes whose candidates are all theirs to decide on; they take one if it is the only one."""
    whole = pairs.groupBy("note").agg(F.bool_and("first").alias("ready"), F.count(F.lit(1)).alias("n"), F.min("original").alias("original"))
    return whole.where("ready").select("note", F.when(F.col("n") == 1, F.col("original")).alias("original"))


def match(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Original of every note in a ``converted`` folder: note, original, way (exact, fuzzy, none).

    ``notes``: path, content; ``files``: path of all files of the vault.  Paths are unique and relative to the root.  Order is that of path
    components.  An original that a note claims in the first pass is no candidate in the second.
    """
    scanned = checkpointed(converted_notes(notes))
    exact = _settled(exact_candidates(scanned, files), _best_free)
    open_ = scanned.join(exact.select("note"), "note", "left_anti")
    rest = fuzzy_candidates(open_, files).join(exact.select("original"), "original", "left_anti")
    fuzzy = _settled(rest.select("note", "order", "original"), _only_free)
    found = exact.select("note", "original", F.lit("exact").alias("way")).unionByName(fuzzy.select("note", "original", F.lit("fuzzy").alias("way")))
    return scanned.select("note").join(found, "note", "left").withColumn("way", F.coalesce("way", F.lit("none")))


# companions ------------------------------------------------------------------------------------
# How a front-matter block and the header fence of a mail begin.
_FRONT = r"(?s)\A---\r?\n(.*?)\n---\n?"
_HEADER = r"\A(?:Date|From|To|CC|BCC|Subject):"


def _after_blanks(lines: Column, at: Column) -> Column:
    """First place from ``at`` on whose line is not blank, or the number of lines."""
    return F.coalesce(
        F.array_min(F.filter(F.transform(lines, lambda l, i: F.when(text.strip(l) != "", i)), lambda i: i >= at)), F.size(lines)
    )


def preamble_split(body: Column) -> Column:
    """Struct (preamble, rest): a leading first-level heading and the fenced header of a mail stay apart from the text.

    A rule that follows the header goes.
    """
    def split(lines: Column) -> Column:
        line = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        titled = line(F.lit(0)).startswith("# ")

        def headed(at: Column) -> Column:
            marks = F.filter(F.transform(lines, lambda l, i: F.when(text.strip(l) == "```", i)), lambda i: i > at + 1)
            fence = (text.strip(line(at)) == "```") & text.strip(line(at + 1)).rlike(_HEADER)
            close = F.when(fence, F.array_min(marks))

            def ended(end: Column) -> Column:
                def ruled(next_: Column) -> Column:
                    return F.when(text.strip(line(next_)) == "---", _after_blanks(lines, next_ + 1)).otherwise(next_)

                start = F.when(end.isNull(), at).otherwise(text.let(_after_blanks(lines, end + 1), ruled))
                header = F.slice(lines, at + 1, end - at + 1)
                title = F.when(titled, F.array(line(F.lit(0)))).otherwise(F.array().cast("array<string>"))
                gap = F.when(titled, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
                pre = F.when(end.isNull(), title).otherwise(F.concat(title, gap, header))
                rest = text.let(start, lambda s: F.array_join(F.slice(lines, s + 1, F.greatest(F.size(lines) - s, F.lit(0))), "\n"))
                return F.struct(F.array_join(pre, "\n").alias("preamble"), text.rstrip(rest).alias("rest"))

            return text.let(close, ended)

        return text.let(F.when(titled, _after_blanks(lines, F.lit(1))).otherwise(F.lit(0)), headed)

    return text.let(text.lines(F.regexp_replace(body, r"\A\n+", "")), split)


def pointed_front(front: Column, source: Column, now: str) -> Column:
    """Front matter (without its marks, NULL if there is none) whose ``source:`` names ``source``."""
    entry = F.concat(F.lit('source: "'), source, F.lit('"'))

    def put(lines: Column) -> Column:
        replaced = F.transform(lines, lambda l: F.when(l.startswith("source:"), entry).otherwise(l))
        given = F.exists(lines, lambda l: l.startswith("source:"))
        return F.array_join(F.when(given, replaced).otherwise(F.concat(lines, F.array(entry))), "\n")

    return F.when(front.isNull(), F.concat(entry, F.lit(f"\nconverted: {now}"))).otherwise(text.let(text.lines(front), put))


def companion(legacy: Column, original: Column, source: Column, now: str) -> Column:
    """Companion note made of a converted note: its front matter, an embed of the original, its preamble, and its text in a callout."""
    closed = legacy.rlike(_FRONT)
    front = F.when(closed, F.regexp_extract(legacy, _FRONT, 1))
    body = F.when(closed, F.regexp_replace(legacy, _FRONT, "")).otherwise(legacy)

    def built(parts: Column) -> Column:
        pre = F.when(parts["preamble"] != "", F.concat(F.lit("\n"), parts["preamble"], F.lit("\n"))).otherwise("")
        return F.concat(
            F.lit("---\n"), pointed_front(front, source, now), F.lit("\n---\n\n![["), original, F.lit("]]\n"), pre,
            F.lit("\n"), text_callout(parts["rest"]), F.lit("\n"),
        )

    return text.let(preamble_split(body), built)
