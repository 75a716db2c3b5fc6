"""Transcripts: cues, speaker blocks, paragraphs, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import skew, text

# Cue grammar -------------------------------------------------------------------
_CLOCK = r"(?:(\d{1,2}):(\d{2}):(\d{2})[.,](\d{3})|(\d{1,2}):(\d{2})[.,](\d{3}))"
_VOICE = r"(?U)<v\s+([^>]+)>"
_SPEAKER = r"(?Us)\A((?:\S+\s+){0,3}\S+):\s+(.+)\z"


def seconds(c: Column) -> Column:
    """Seconds of the first clock reading in a text, NULL without one."""
    def part(i: int) -> Column:
        return F.coalesce(text.present(F.regexp_extract(c, _CLOCK, i)).cast("int"), F.lit(0))

    return F.when(
        c.rlike(_CLOCK),
        part(1) * 3600 + (part(2) + part(5)) * 60 + part(3) + part(6)
        + (part(4) + part(7)) / F.lit(1000.0),
    )


def clock(total: Column) -> Column:
    """H:MM:SS."""
    t = F.floor(total).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(t / 3600), F.floor((t % 3600) / 60), t % 60)


def plain_text(c: Column) -> Column:
    return text.strip(text.collapse_spaces(F.regexp_replace(c, r"<[^>]+>", "")))


def parse_cues(files: DataFrame) -> DataFrame:
    """Cues of caption files (file, content): file, pos, start, end, speaker, text.

    A cue is the part of a blank-line separated chunk after its first valid timing line, unless a
    line before that begins a note.
    """
    lines = text.lines(F.col("content"))
    chunks = F.split(
        F.array_join(F.transform(lines, lambda l: F.when(text.strip(l) == "", "").otherwise(l)), "\n"), r"\n\n+"
    )
    rows = files.select("file", F.posexplode_outer(chunks).alias("pos", "chunk")).where(
        F.col("chunk").contains("-->")
    ).select("file", "pos", F.split("chunk", "\n").alias("_lines"))

    def timing(l: Column) -> Column:
        return (
            seconds(F.substring_index(l, "-->", 1)).isNotNull()
            & seconds(F.get(F.split(l, "-->"), F.lit(1))).isNotNull()
        )

    at = F.array_position(F.transform("_lines", timing), F.lit(True)).cast("int")
    timed = rows.withColumn("_at", at).where("_at > 0").where(
        ~F.exists(F.slice("_lines", F.lit(1), F.col("_at") - 1), lambda l: text.strip(l).startswith("NOTE"))
    )
    raw = F.array_join(F.slice("_lines", F.col("_at") + 1, F.size("_lines")), " ")
    cues = timed.select(
        "file", "pos", F.element_at("_lines", F.col("_at")).alias("_timing"), raw.alias("_raw"),
    ).where("_raw <> ''").withColumn("_plain", plain_text(F.col("_raw")))
    voice, spoken = F.col("_raw").rlike(_VOICE), F.col("_plain").rlike(_SPEAKER)
    return cues.select(
        "file", "pos", seconds(F.substring_index("_timing", "-->", 1)).alias("start"),
        seconds(F.get(F.split("_timing", "-->"), F.lit(1))).alias("end"),
        F.when(voice, text.strip(F.regexp_extract("_raw", _VOICE, 1)))
        .when(spoken, text.strip(F.regexp_extract("_plain", _SPEAKER, 1))).otherwise("").alias("speaker"),
        F.when(~voice & spoken, text.strip(F.regexp_extract("_plain", _SPEAKER, 2)))
        .otherwise(F.col("_plain")).alias("text"),
    ).where("text <> ''")


def with_blocks(cues: DataFrame, gap: float = 120.0) -> DataFrame:
    """Cues plus ``block``: position of the first cue of their speaker block.

    A block ends when the speaker changes or more than ``gap`` seconds pass after the last cue.
    """
    linked = skew.with_previous(cues, ["file"], "pos", ["speaker", "end"])
    starts = (
        F.col("previous").isNull() | (F.col("previous.speaker") != F.col("speaker"))
        | (F.col("start") - F.col("previous.end") > gap)
    )
    return skew.with_last_start(linked, ["file"], "pos", starts, "block").drop("previous")


def paragraphs(cues: Column, max_length: int = 500) -> Column:
    """Paragraphs of the ordered cues of one block.

    Text runs on until it ends in a full stop; after that the next cue joins only within three
    seconds and while the result stays within ``max_length``.  0 keeps every cue apart.
    """
    if max_length == 0:
        return F.transform(cues, lambda c: c["text"])
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"),
        F.lit(None).cast("double").alias("end"),
    )

    def step(acc: Column, cue: Column) -> Column:
        merged = F.concat(acc["open"], F.lit(" "), cue["text"])
        joins = ~acc["open"].endswith(".") | (
            (cue["start"] - acc["end"] < 3.0) & (F.length(merged) <= max_length)
        )
        return F.struct(
            F.when(acc["open"].isNull() | joins, acc["done"])
            .otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(acc["open"].isNotNull() & joins, merged).otherwise(cue["text"]).alias("open"),
            cue["end"].alias("end"),
        )

    return F.aggregate(cues, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def paragraph_rows(cues: DataFrame, gap: float = 120.0, max_length: int = 500) -> DataFrame:
    """Paragraphs of all speaker blocks as rows: file, block, at, paragraph.

    A full stop followed by three seconds or more always ends a paragraph, so a block is cut there first and only the
    cues between two such pauses are folded together; ``at`` counts the paragraphs of a block from 0.
    """
    linked = skew.with_previous(cues, ["file"], "pos", ["speaker", "end", "text"])
    before, pause = F.col("previous"), F.col("start") - F.col("previous.end")
    starts = before.isNull() | (before["speaker"] != F.col("speaker")) | (pause > gap)
    breaks = starts | (before["text"].endswith(".") & (pause >= 3.0)) if max_length else F.lit(True)
    placed = skew.with_last_start(linked, ["file"], "pos", starts, "block")
    pieces = skew.with_last_start(placed, ["file"], "pos", breaks, "piece").groupBy("file", "block", "piece").agg(
        paragraphs(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))), max_length).alias("_texts")
    )
    earlier = Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.select("file", "block", "piece", F.size("_texts").alias("_n"))
    first = sizes.select("file", "block", "piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    rows = pieces.join(first, ["file", "block", "piece"]).select("file", "block", "_first", F.posexplode("_texts").alias("_at", "paragraph"))
    return rows.select("file", "block", (F.col("_first") + F.col("_at")).alias("at"), "paragraph")


def blocks(cues: DataFrame, gap: float = 120.0, max_length: int = 500) -> DataFrame:
    """Speaker blocks: file, block, speaker, start, end, cues, paragraphs, timed.

    ``timed`` marks blocks that follow a pause of at least ``gap`` seconds.
    """
    grouped = with_blocks(cues, gap).groupBy("file", "block", "speaker").agg(
        F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"),
        F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("_cues"),
    )
    described = grouped.select(
        "file", "block", "speaker", "start", "end", F.size("_cues").alias("cues"),
        paragraphs(F.col("_cues"), max_length).alias("paragraphs"),
    )
    linked = skew.with_previous(described, ["file"], "block", ["end"])
    pause = F.col("start") - F.col("previous.end")
    return linked.withColumn("timed", F.coalesce(pause >= gap, F.lit(False))).drop("previous")


def overview(cues: DataFrame) -> DataFrame:
    """Per file: speakers in order of appearance and the duration.

    Speakers are reduced to their first position before they are gathered.
    """
    first = cues.where("speaker <> ''").groupBy("file", "speaker").agg(F.min("pos").alias("first"))
    speakers = first.groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda s: s["speaker"]).alias("speakers")
    )
    spans = cues.groupBy("file").agg(F.max_by("end", "pos").alias("_end"))
    return spans.join(speakers, "file", "left").select(
        "file", F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"),
        clock(F.col("_end")).alias("duration"),
    )


def block_markdown(with_speakers: Column) -> Column:
    """Markdown of one block row."""
    stamp = F.when(F.col("timed"), F.concat(F.lit("_"), clock(F.col("start")), F.lit("_\n"))).otherwise("")
    who = F.when(
        with_speakers & (F.col("speaker") != ""), F.concat(F.lit("**"), F.col("speaker"), F.lit("**\n"))
    ).otherwise("")
    return F.concat(stamp, who, F.array_join("paragraphs", "\n\n"))
