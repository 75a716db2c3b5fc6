"""Plain mentions of many titles at once: made links where they stand, and the orphans they save.

Titles are dealt into shards of bounded size in the shared folder.  A task compiles one shard at a time into an automaton with failure links and
runs its texts through it once, however many titles the shard has; what is found is checked and settled note by note.
"""

from __future__ import annotations

import bisect
import functools
import re
import uuid
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, paths, text
from ..session import checkpoint_folder, checkpointed
from . import rewrite

#: Titles of a shard; it bounds the memory of a task, not what is found.
SHARD = 100_000
#: Text characters that a task holds while it goes through the shards.
SLICE = 16 << 20
# What is left alone in a line, the shortest title, and the extension a mention may have.
_SKIP = re.compile(r"\[\[[^\]\n]+\]\]|\[(?:[^\]\n]*)\]\([^)\n]*\)|`[^`\n]*`")
_LEAST, _EXTENSION = 3, ".md"
_WORD = re.compile(r"\w")

Occurrence = tuple[str, int, int]


def titles(pages: DataFrame) -> DataFrame:
    """Titles of pages (path): stem, first, second (the first two pages of that stem in path order)."""
    stems = pages.select(paths.stem(F.col("path")).alias("stem"), "path").where(F.length("stem") >= _LEAST)
    first = stems.groupBy("stem").agg(F.min("path").alias("first"))
    other = stems.join(first, "stem").where("path <> first").groupBy("stem").agg(F.min("path").alias("second"))
    return first.join(other, "stem", "left")


def _sharded(found: DataFrame) -> str:
    spark = found.sparkSession
    # counted and written: whatever gives the titles runs once
    found = checkpointed(found)
    folder = f"{checkpoint_folder(spark).rstrip('/')}/titles-{uuid.uuid4().hex}"
    shards = max(-(-found.count() // SHARD), 1)
    found.repartition(shards, "stem").write.option("maxRecordsPerFile", 2 * SHARD).parquet(folder)
    return folder


@functools.lru_cache(maxsize=1)
def _automaton(folder: str, file: str):
    """Automaton of a shard, or None for an empty one; a worker keeps the last."""
    import ahocorasick

    store, _ = fs.FileSystem.from_uri(folder)
    made = ahocorasick.Automaton()
    for row in pq.read_table(file, filesystem=store).to_pylist():
        made.add_word(row["stem"], (len(row["stem"]), row["first"], row["second"]))
    if not len(made):
        return None
    made.make_automaton()
    return made


def _files(folder: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(folder)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))


def _segments(content: str) -> list[tuple[int, int]]:
    """Stretches in which mentions count: no front matter, links or inline code; none crosses a line end."""
    lines = content.splitlines(keepends=True)
    body = 0
    if lines and lines[0].strip() == "---":
        body = next((i + 1 for i, line in enumerate(lines) if i and line.strip() in ("---", "...")), 0)
    at, out = 0, []
    for i, line in enumerate(lines):
        if i >= body:
            last = 0
            for m in _SKIP.finditer(line):
                out.append((at + last, at + m.start()))
                last = m.end()
            out.append((at + last, at + len(line)))
        at += len(line)
    return [s for s in out if s[0] < s[1]]


def _in_word(content: str, left: int, right: int) -> bool:
    """Whether a word goes on over an end of an occurrence: it is no mention then, whatever else stands in the text."""

    def word(at: int) -> bool:
        return content[at].isalnum() or content[at] == "_"

    return (left > 0 and word(left - 1) and word(left)) or (right < len(content) and word(right) and word(right - 1))


def settled(content: str, left: int, right: int, found: list[Occurrence]) -> list[tuple[str, int, int, int]]:
    """The occurrences (page, start, stop) within ``left`` to ``right`` that become links: page, start, stop of the title and of what is replaced.

    Pages come in order, and each takes its mentions from left to right; what an earlier page took ends the text for later ones.
    """
    starts, stops, out, group = [], [], [], []

    def close() -> None:
        for _, a, _, b in group:
            i = bisect.bisect(starts, a)
            starts.insert(i, a)
            stops.insert(i, b)
        out.extend(group)
        group.clear()

    page = None
    for owner, a, b in sorted(found):
        if owner != page:
            close()
            page = owner
        if group and a < group[-1][3]:
            continue
        i = bisect.bisect(starts, a)
        low, high = stops[i - 1] if i else left, starts[i] if i < len(starts) else right
        if a < low or b > high or (a > low and _WORD.match(content[a - 1])):
            continue
        longer, stop = b + len(_EXTENSION), b
        if longer <= high and content[b:longer] == _EXTENSION and (longer == high or not _WORD.match(content[longer])):
            stop = longer
        elif b < high and _WORD.match(content[b]):
            continue
        group.append((owner, a, b, stop))
    close()
    return sorted(out, key=lambda o: o[1])


def _linked(path: str, content: str, found: list[tuple[int, int, str, str | None]]) -> tuple[str, dict[str, int]]:
    """The note with its mentions made links, and the number of links by page."""
    spans = _segments(content)
    lefts = [a for a, _ in spans]
    inside: dict[int, list[Occurrence]] = {}
    for a, b, first, second in found:
        if _in_word(content, a, b):
            continue
        owner = second if first == path else first
        i = bisect.bisect(lefts, a) - 1
        if owner is not None and i >= 0 and b <= spans[i][1]:
            inside.setdefault(i, []).append((owner, a, b))
    pieces, counts, last = [], {}, 0
    for i in sorted(inside):
        for owner, a, b, stop in settled(content, *spans[i], inside[i]):
            pieces += [content[last:a], f"[[{content[a:b]}]]"]
            counts[owner] = counts.get(owner, 0) + 1
            last = stop
    return "".join(pieces) + content[last:], counts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
    rows, size = [], 0
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows.append((path, content))
            size += len(content)
            if size >= SLICE:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _occurrences(folder: str, files: list[str], rows: list[tuple[str, str]]) -> tuple[list[array], list[tuple[str, str | None]]]:
    """Titles that stand in texts (path, content): start, stop and title number one after the other for each text, and the pages of each number.

    Common titles are found millions of times in a slice, so an occurrence is three numbers and no object.
    """
    found, numbers = [array("q") for _ in rows], {}
    for file in files:
        automaton = _automaton(folder, file)
        if automaton is not None:
            for hits, (_, content) in zip(found, rows):
                for end, (n, first, second) in automaton.iter(content):
                    hits.extend((end + 1 - n, end + 1, numbers.setdefault((first, second), len(numbers))))
    return found, list(numbers)


def linked(notes: DataFrame, orphans: DataFrame, texts: bool = True) -> DataFrame:
    """Notes (path, content) with the plain mentions of ``orphans`` (path) made links: path, content, links, changed.

    Without ``texts`` the new content is left out (NULL), for those who only need the links.

    ``links`` is an array of (page, n).  A page does not get links from its own text; of pages of one stem the first in path order that is not
    the note itself is credited.  Where titles overlap the page that comes first in path order has its mention.
    """
    folder = _sharded(titles(orphans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(folder)
        for rows in _slices(batches):
            found, pages = _occurrences(folder, files, rows)
            made = [
                _linked(path, content, [(a, b, *pages[i]) for a, b, i in zip(hits[::3], hits[1::3], hits[2::3])]) if hits else (content, {})
                for hits, (path, content) in zip(found, rows)
            ]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([r[0] for r in rows], pa.string()), "content": pa.array([m[0] if texts else None for m in made], pa.string()),
                "links": pa.array([[{"page": p, "n": n} for p, n in sorted(m[1].items())] for m in made], pa.list_(pa.struct([("page", pa.string()), ("n", pa.int64())]))),
                "changed": pa.array([bool(m[1]) for m in made]),
            })

    rows = notes.select("path", F.coalesce("content", F.lit("")).alias("content"))
    return rows.mapInArrow(run, "path string, content string, links array<struct<page: string, n: bigint>>, changed boolean")


def mentioned(texts: DataFrame, stems: DataFrame) -> DataFrame:
    """Stems that stand in a text (path, content) as whole words, alone or with ``.md``: stem, path (of the text); each pair once a row of texts.

    Empty stems are found nowhere.
    """
    alone = stems.where("stem <> ''").select("stem", F.lit("").alias("first"), F.lit(None).cast("string").alias("second")).distinct()
    folder = _sharded(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(folder)
        for rows in _slices(batches):
            for file in files:
                automaton = _automaton(folder, file)
                if automaton is None:
                    continue
                stems, where = [], []
                for path, content in rows:
                    seen: set[str] = set()
                    for end, (n, _, _) in automaton.iter(content):
                        stem = content[end + 1 - n : end + 1]
                        if stem not in seen and not _in_word(content, end + 1 - n, end + 1) and settled(content, 0, len(content), [("", end + 1 - n, end + 1)]):
                            seen.add(stem)
                    stems += seen
                    where += [path] * len(seen)
                yield pa.RecordBatch.from_pydict({"stem": pa.array(stems, pa.string()), "path": pa.array(where, pa.string())})

    return texts.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(run, "stem string, path string")


def repairs(notes: DataFrame, raw_texts: DataFrame, orphans: DataFrame) -> DataFrame:
    """What is done for every orphan (path): path, references_linked, files_changed, frontmatter.

    ``frontmatter``: an orphan with new links loses ``orphan: false`` (removed_orphan_false), one that only raw texts mention gains it
    (added_orphan_false); NULL where the flag stays as it is.
    """
    links = linked(notes, orphans, texts=False).where("changed").select(F.explode("links").alias("l")).select("l.page", "l.n")
    counts = links.groupBy(F.col("page").alias("path")).agg(F.sum("n").alias("references_linked"), F.count(F.lit(1)).alias("files_changed"))
    # read in the row, so that no text is shuffled; the substring test spares most notes the line split
    flag = F.col("content").contains("orphan") & frontmatter.has_flag(text.lines(F.col("content")), "orphan", "false")
    flagged = notes.select(
        "path", F.coalesce(flag, F.lit(False)).alias("_flag"), paths.stem(F.col("path")).alias("stem")
    ).join(orphans.select("path"), "path", "left_semi")
    # both the titles sought in raw texts and the result come from here: the notes are gone through once
    rows = checkpointed(flagged.join(counts, "path", "left").na.fill(0, ["references_linked", "files_changed"]))
    lonely = rows.where("references_linked = 0 AND NOT _flag").where(F.length("stem") >= _LEAST)
    raw = mentioned(raw_texts, lonely).select("stem").distinct().withColumn("_raw", F.lit(True))
    some = F.col("references_linked") > 0
    action = F.when(some & F.col("_flag"), "removed_orphan_false").when(~some & ~F.col("_flag") & F.col("_raw"), "added_orphan_false")
    return rows.join(raw, "stem", "left").select("path", "references_linked", "files_changed", action.alias("frontmatter"))


def repaired(notes: DataFrame, raw_texts: DataFrame, orphans: DataFrame) -> DataFrame:
    """All notes as they are after the repair: path, content, changed."""
    actions = repairs(notes, raw_texts, orphans).where("frontmatter IS NOT NULL").select("path", "frontmatter")
    rows = linked(notes, orphans).join(actions, "path", "left")
    flagged = F.when(F.col("frontmatter") == "added_orphan_false", rewrite.with_key(F.col("content"), "orphan", "false")).when(
        F.col("frontmatter") == "removed_orphan_false", rewrite.without_key(F.col("content"), "orphan", "false")
    ).otherwise(F.col("content"))
    return rows.select("path", flagged.alias("content"), (F.col("changed") | F.col("frontmatter").isNotNull()).alias("changed"))
