"""Index pages: one line per page of a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, paths, text, vocab

_NO_SUMMARY = "No summary available."


def title_and_summary(path: Column, all_lines: Column) -> Column:
    """struct(title, summary): first heading and the first sentence of the first text line after it."""
    def parse(lines: Column) -> Column:
        opened = F.coalesce(text.strip(F.get(lines, F.lit(0))) == "---", F.lit(False))
        closes = F.transform(lines, lambda l, i: (i > 0) & (text.strip(l) == "---"))
        end = F.when(opened, F.array_position(closes, F.lit(True))).otherwise(0).cast("int")
        body = F.filter(
            F.transform(F.slice(lines, end + 1, F.size(lines)), text.strip), lambda l: l != ""
        )

        def of(rows: Column) -> Column:
            at = F.array_position(F.transform(rows, lambda l: l.startswith("#")), F.lit(True)).cast("int")
            after = F.filter(F.slice(rows, at + 1, F.size(rows)), lambda l: ~l.startswith("#"))
            heading = F.regexp_replace(F.get(rows, at - 1), r"(?U)\A#+[\s\x1c-\x1f]*", "")
            return F.struct(
                F.when(at > 0, heading).otherwise(paths.stem(path)).alias("title"),
                F.coalesce(F.when(at > 0, F.get(after, F.lit(0))), F.lit(_NO_SUMMARY)).alias("text"),
            )

        return text.let(body, of)

    found = text.let(all_lines, parse)
    sentence = r"(?U)\A(.+?[.!?])(?:[\s\x1c-\x1f].*)?\z"
    return text.let(
        found,
        lambda f: F.struct(
            f["title"].alias("title"),
            F.regexp_replace(f["text"], sentence, "$1").alias("summary"),
        ),
    )


def index_entries(pages: DataFrame) -> DataFrame:
    """Index lines of topic pages (path, content): topic, path, line.

    Lines stay rows; a topic with very many pages is sorted and written by many tasks.
    """
    name = paths.name(F.col("path"))
    rows = pages.where(F.col("path").rlike(r"\Awiki/[^/]+/[^/]+\.md\z") & (name != "_index.md")).select(
        F.split("path", "/")[1].alias("topic"), "path",
        title_and_summary(F.col("path"), text.lines(F.col("content"))).alias("t"),
    ).where(F.col("topic").isin(list(vocab.TOPICS)))
    return rows.select(
        "topic", "path",
        F.concat(
            F.lit("- [["), paths.drop_md(F.col("path")), F.lit("|"), F.col("t.title"), F.lit("]] — "), F.col("t.summary")
        ).alias("line"),
    )


def index_pages(entries: DataFrame, today: str) -> DataFrame:
    """All lines of all topic indexes in order: topic, ordinal, path, line.

    Sort by (topic, ordinal, path) to read an index; header lines have ordinals below 10.
    """
    spark = entries.sparkSession
    header = []
    for topic, (name, description) in vocab.TOPICS.items():
        text_lines = ["---", "type: index", f"date: {today}", "---", f"# {name} - index",
                      "[[wiki/index|← Index]]", "", description, ""]
        header += [(topic, i, "", line) for i, line in enumerate(text_lines)]
    # eight fixed headers
    head = spark.createDataFrame(header, "topic string, ordinal int, path string, line string")
    empty = spark.createDataFrame([(t,) for t in vocab.TOPICS], "topic string").join(
        entries.select("topic").distinct(), "topic", "left_anti"
    ).select("topic", F.lit(10).alias("ordinal"), F.lit("").alias("path"), F.lit("_No pages yet._").alias("line"))
    return head.unionByName(empty).unionByName(
        entries.select("topic", F.lit(10).alias("ordinal"), "path", "line")
    )


def root_index(today: str) -> str:
    rows = "".join(
        f"| [[wiki/{topic}/_index\\|{name}]] | {description} |\n"
        for topic, (name, description) in vocab.TOPICS.items()
    )
    return (
        f"---\ntype: index\ndate: {today}\n---\n# Wiki Index\n\n"
        f"| Section | Description |\n|---------|-------------|\n{rows}"
    )
