"""The ingest log: JSON Lines, tolerant of damage, keys we do not know kept verbatim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

LOG_SCHEMA = (
    "date string, session string, file string, summary string, pages_created array<string>, "
    "pages_updated array<string>, hash string, mtime bigint, migration_baseline boolean"
)


def parse_lines(lines: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """Log rows from (line_no, value): the known fields, ``raw`` text and ``malformed`` flag.

    Blank lines are dropped.  A line is malformed when it is no JSON; a value of an unexpected
    type reads as NULL and does not spoil the rest of its line.
    """
    rows = lines.where(text.strip(F.col("value")) != "")

    def field(name: str, wanted: str, accept: str | None = None) -> Column:
        raw = F.try_variant_get(F.col("_json"), f"$.{name}", wanted)
        if accept is None:
            return raw.alias(name)
        return F.when(F.col(f"_type_{name}") == accept, raw).alias(name)

    parsed = rows.withColumn("_json", F.try_parse_json("value")).withColumns(
        {
            f"_type_{name}": F.schema_of_variant(
                F.try_variant_get(F.col("_json"), f"$.{name}", "variant")
            )
            for name in ("hash", "mtime", "file", "pages_created", "pages_updated")
        }
    )
    string_list = "array<string>"
    return parsed.select(
        "line_no", F.col("value").alias("raw"), F.col("_json").isNull().alias("malformed"),
        F.coalesce(field("date", "string"), F.lit("")).alias("date"),
        field("session", "string"), field("file", "string", "STRING"), field("summary", "string"),
        field("pages_created", string_list), field("pages_updated", string_list),
        F.col("_type_pages_created").isNotNull().alias("has_created"),
        F.col("_type_pages_updated").isNotNull().alias("has_updated"),
        field("hash", "string", "STRING"), field("mtime", "bigint", "BIGINT"),
        field("migration_baseline", "boolean"),
    )


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of log files; ``line_no`` orders them by argument, file, and position in the file.

    It is a struct: an order, not consecutive numbers.  Splits are packed by size, so the row ids of one read only
    order the lines of one split.  Of equal keys in a line the last one counts; both settings are the session's.
    """
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    def place(argument: int) -> Column:
        return F.struct(
            F.lit(argument).alias("argument"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"),
        ).alias("line_no")

    parts = [spark.read.text(path).select("value", place(i)) for i, path in enumerate(paths)]
    return parse_lines(reduce(DataFrame.unionByName, parts))


def updated_line(raw: Column, updates: dict[str, Column]) -> Column:
    """Log line with some values replaced; unknown keys and key order survive.

    A NULL update leaves its key as it is.  New keys go to the end.
    """
    entry = F.from_json(raw, "map<string,variant>")
    given = F.map_filter(
        F.create_map(*[x for k, v in updates.items() for x in (F.lit(k), v.cast("variant"))]),
        lambda k, v: v.isNotNull(),
    )
    replaced = F.transform_values(entry, lambda k, v: F.coalesce(F.try_element_at(given, k), v))
    added = F.map_filter(given, lambda k, v: ~F.map_contains_key(entry, k))
    return F.to_json(F.map_concat(replaced, added))
