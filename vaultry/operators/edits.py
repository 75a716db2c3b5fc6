"""Edits by offset, and links that follow a migration by such edits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import links, paths
from ..functions.skew import shuffled
from ..session import checkpointed
from ..sources.ledger import updated_line
from . import relocation, vault_links

# A front-matter line that holds a path as plain text, and the characters a rewritten Markdown target keeps.
_SOURCE = re.compile(r'^source:\s*"?([^"\n]+?)"?\s*$', re.M)
_SAFE = "/!$&'()*+,:;=@~-._"
_EDITS = "array<struct<start: bigint, stop: bigint, text: string>>"


def _once(content: str, edits: list[dict]) -> tuple[str, int]:
    """The edits applied from left to right; one that begins before the last one ended is left out."""
    pieces, last, n = [], 0, 0
    for start, stop, text in sorted((e["start"], e["stop"], e["text"] or "") for e in edits):
        if start < last or stop < start or stop > len(content):
            continue
        pieces += [content[last:start], text]
        last, n = stop, n + 1
    return "".join(pieces) + content[last:], n


def applied(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Notes (path, content) that have edits (path, start, stop, text): path, content, applied.

    Offsets count code points from 0; ``stop`` is behind the last one replaced.  Each note is put together once, from left to right: edits
    come by start, stop, text, and those that overlap an earlier one, end before they start or lie outside the text are left out.  ``applied`` counts
    those that were made.  A note's edits meet in its row, so they are bounded by its own places.
    """
    per_note = edits.where("start >= 0").groupBy("path").agg(F.collect_list(F.struct("start", "stop", "text")).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [_once(c or "", e) for c, e in zip(part.column("content").to_pylist(), part.column("edits").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "path": part.column("path"), "content": pa.array([m[0] for m in made], pa.string()), "applied": pa.array([m[1] for m in made], pa.int64()),
                })

    rows = notes.select("path", "content").join(shuffled(per_note), "path").select("path", "content", F.col("edits").cast(_EDITS).alias("edits"))
    return rows.mapInArrow(run, "path string, content string, applied bigint")


def link_places(notes: DataFrame) -> DataFrame:
    """Targets in notes (path, content) with their places: path, start, stop, type, raw, target; ``source:`` lines have the type source.

    ``raw`` is the beginning of the match, ``target`` is stripped, ``start`` to ``stop`` is what stands in the text.
    """
    patterns = [("wikilink", links.WIKILINK), ("image", links.EMBED), ("markdown", links.MDLINK), ("image", links.MDIMAGE)]
    compiled = [(kind, re.compile(p)) for kind, p in patterns] + [("source", _SOURCE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for kind, pattern in compiled:
                    for m in pattern.finditer(content or ""):
                        out.append((path, m.start(1), m.end(1), kind, m[0][:4], m[1].strip()))
            columns = list(zip(*out)) if out else [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "start", "stop", "type", "raw", "target"])

    schema = "path string, start bigint, stop bigint, type string, raw string, target string"
    return notes.select("path", "content").mapInArrow(run, schema)


def _quoted(targets: Column) -> Column:
    return F.pandas_udf(lambda column: column.map(lambda t: quote(t, safe=_SAFE)), StringType())(targets)


def _first_move(rows: DataFrame, moves: DataFrame, keys: list[Column], by: list[str]) -> DataFrame:
    """``new`` of the first of several spellings that is a moved path, for every row of ``by``."""
    spelled = rows.select(*by, F.posexplode(F.array(*keys)).alias("_order", "old")).where("old IS NOT NULL")
    return spelled.join(shuffled(moves), "old").groupBy(*by).agg(F.min_by("new", "_order").alias("new"))


def migration_edits(notes: DataFrame, files: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits that let links follow moved files: path (as in ``notes``), start, stop, text.

    ``notes``: path, content before the moves; ``files``: path before; ``moves``: old, new.  Links that still mean a file afterwards stay.
    A wikilink or embed takes the moved file it meant (see :func:`vaultry.operators.relocation.moved_targets`), a Markdown link the one beside the note or
    from the root, percent-encoded if it was; a ``source:`` line keeps its relative form where the new place lies below the note's folder.
    """
    after = relocation.files_after(files, moves)
    there = notes.select("path").join(shuffled(moves.select(F.col("old").alias("path"), "new")), "path", "left").select(
        "path", F.coalesce("new", "path").alias("_new_path"), paths.parent(F.col("path")).alias("folder")
    )
    # kept once: every kind of edit reads them, and each would parse the notes and shuffle their links again
    places = checkpointed(link_places(notes).join(shuffled(there), "path").where((F.col("target") != "") & ~F.col("target").startswith("#")))
    found = places.where("type <> 'source'").select(
        F.col("_new_path").alias("path"), F.lit(0).alias("line"), F.struct("path", "start", "stop", "folder").alias("position"), "type", "raw", "target",
        F.lit(False).alias("in_front_matter"),
    )
    gone = checkpointed(vault_links.broken(found, after).select("position.*", "target", "wiki_style"))

    wiki = gone.where("wiki_style")
    wiki_moves = relocation.moved_targets(wiki.select("target", "folder"), moves)
    bare = F.col("new_path").endswith(".md") & ~F.col("target").endswith(".md")
    wiki_edits = wiki.join(shuffled(wiki_moves), ["target", "folder"]).select(
        "path", "start", "stop", F.when(bare, F.regexp_replace("new_path", r"\.md\z", "")).otherwise(F.col("new_path")).alias("text")
    )

    def inside(folder: Column, rest: Column) -> Column:
        return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))

    md = gone.where("NOT wiki_style").select("path", "start", "stop", "target", "folder")
    spelled = md.select("target", "folder").distinct().withColumn("_plain", paths.url_decoded(F.col("target")))
    near, root = paths.resolved(inside(F.col("folder"), F.col("_plain"))), paths.resolved(F.col("_plain"))
    md_moves = _first_move(spelled, moves, [near, F.concat(near, F.lit(".md")), root, F.concat(root, F.lit(".md"))], ["target", "folder"])
    md_edits = md.join(shuffled(md_moves), ["target", "folder"]).select(
        "path", "start", "stop", F.when(F.col("target").contains("%"), _quoted(F.col("new"))).otherwise(F.col("new")).alias("text")
    )

    told = places.where("type = 'source'").select("path", "start", "stop", "target", "folder", paths.parent(F.col("_new_path")).alias("_below"))
    plain = F.regexp_replace("target", r"\A\./", "")
    whole = told.join(shuffled(moves.withColumnRenamed("old", "_plain")), plain == F.col("_plain")).select("path", "start", "stop", F.col("new").alias("text"), "target")
    rest = told.join(shuffled(moves.select(F.col("old").alias("_plain"))), plain == F.col("_plain"), "left_anti")
    beside = rest.join(shuffled(moves.withColumnRenamed("old", "_near")), paths.resolved(inside(F.col("folder"), plain)) == F.col("_near"))
    prefix = F.concat("_below", F.lit("/"))
    relative = F.when((F.col("_below") != "") & F.startswith("new", prefix), F.substring("new", F.length(prefix) + 1, F.length("new"))).otherwise(F.col("new"))
    source_edits = whole.unionByName(beside.select("path", "start", "stop", relative.alias("text"), "target")).where("text <> target").drop("target")
    return wiki_edits.unionByName(md_edits).unionByName(source_edits)


def log_after_moves(log: DataFrame, moves: DataFrame) -> DataFrame:
    """Log rows (of a reader, with ``raw``) as lines in which moved files have their new paths: line_no, value, moved; damaged lines stay."""
    joined = log.withColumn("_old", paths.tidy(F.col("file"))).join(shuffled(moves.select(F.col("old").alias("_old"), "new")), "_old", "left")
    moved = F.col("new").isNotNull() & ~F.col("malformed")
    line = F.when(moved, updated_line(F.col("raw"), {"file": F.col("new")})).otherwise(F.col("raw"))
    return joined.select("line_no", line.alias("value"), moved.alias("moved"))

