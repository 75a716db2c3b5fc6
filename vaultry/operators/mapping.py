"""From search hits to pages and notes, and from notes to the pages they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, names, paths, text


def parse_hit_lines(lines: DataFrame) -> DataFrame:
    """(rank, id) from ordered ``score,path`` lines (line_no, value); other lines are dropped."""
    line = text.strip(F.col("value"))
    score = text.strip(F.substring_index(line, ",", 1))
    return lines.where(line.contains(",") & score.try_cast("double").isNotNull()).select(
        F.col("line_no").alias("rank"), text.strip(F.regexp_replace(line, r"\A[^,]*,", "")).alias("id")
    )


def hit_path(hit: Column, scheme: str, collection: str, root: str | None = None) -> Column:
    """Vault path a hit names; NULL for other collections and paths outside the root."""
    hit = text.strip(hit)
    uri = rf"(?s)\A{scheme}://([^/]+)/(.*)\z"
    inside = F.when(F.regexp_extract(hit, uri, 1) == collection, F.regexp_extract(hit, uri, 2))
    if root is None:
        absolute = F.lit(None).cast("string")
    else:
        base = root.rstrip("/") + "/"
        absolute = F.when(hit.startswith(base), paths.resolved(F.substring(hit, len(base) + 1, 1 << 20)))
    return text.present(
        F.when(hit.rlike(uri), inside).when(hit.startswith("/"), absolute)
        .otherwise(F.regexp_replace(hit, r"\A\./", ""))
    )


def _unique(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand for exactly one path."""
    return rows.where(F.col(key) != "").groupBy(key).agg(
        F.min("path").alias("path"), F.max("path").alias("_last")
    ).where("path = _last").drop("_last")


def resolve_hits(
    hits: DataFrame, pages: DataFrame, notes: DataFrame, scheme: str, collection: str, root: str | None = None
) -> DataFrame:
    """Hits with the page or note they mean: rank, id, family, path, first.

    The exact path wins over the unique normalised key.  ``family`` is wiki, raw or unresolved;
    ``first`` marks the best-ranked hit of every path.
    """
    located = hits.withColumn("_rel", hit_path(F.col("id"), scheme, collection, root)).withColumns(
        {"_family": F.regexp_extract("_rel", r"\A(wiki|raw)/", 1), "_key": names.path_key(F.col("_rel"))}
    )
    known = pages.select(F.lit("wiki").alias("_family"), "path").unionByName(
        notes.select(F.lit("raw").alias("_family"), "path")
    ).withColumn("_key", names.path_key(F.col("path")))
    exact = known.select("_family", F.col("path").alias("_rel"), F.col("path").alias("_exact")).distinct()
    keyed = known.groupBy("_family", "_key").agg(
        F.min("path").alias("_only"), F.max("path").alias("_last")
    ).where("_only = _last").drop("_last")
    found = located.join(exact, ["_family", "_rel"], "left").join(keyed, ["_family", "_key"], "left").select(
        "rank", "id", F.coalesce("_exact", "_only").alias("path"), "_family"
    )
    best = found.where("path IS NOT NULL").groupBy("path").agg(F.min("rank").alias("_best"))
    return found.join(best, "path", "left").select(
        "rank", "id", F.when(F.col("path").isNull(), "unresolved").otherwise(F.col("_family")).alias("family"),
        "path", (F.col("rank").eqNullSafe(F.col("_best"))).alias("first"),
    )


def page_keys(pages: DataFrame) -> DataFrame:
    """Title keys that belong to exactly one page, by title or stem: key, path."""
    rows = pages.select(
        "path",
        F.explode(F.array(F.coalesce("title", F.lit("")), paths.stem(F.col("path")))).alias("_value"),
    ).select("path", names.title_key(F.col("_value")).alias("key"))
    return _unique(rows, "key")


def map_notes(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages each raw note supports: note, page, reasons.

    ``notes``: path, title, content.  A page is found by a wikilink of the note or by a spelling
    of the note's title or stem.
    """
    keys = page_keys(pages).withColumnRenamed("path", "page")
    linked = notes.where(F.col("content").contains("[[")).select(
        F.col("path").alias("note"), F.explode_outer(F.array_distinct(links.title_targets(F.col("content")))).alias("_t")
    ).select(
        "note", F.lit("wikilink").alias("reason"),
        F.explode(F.array("_t", paths.drop_md(F.col("_t")), paths.stem(F.col("_t")))).alias("_v"),
    )
    titled = notes.select(
        F.col("path").alias("note"), F.lit("title-match").alias("reason"),
        F.explode_outer(
            F.array_union(
                names.title_variants(F.coalesce("title", F.lit(""))),
                names.title_variants(paths.stem(F.col("path"))),
            )
        ).alias("_v"),
    )
    wanted = linked.unionByName(titled).select(
        "note", "reason", names.title_key(F.col("_v")).alias("key")
    ).distinct()
    met = wanted.join(keys, "key")
    return met.groupBy("note", "page").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def unmapped_notes(notes: DataFrame, mapped: DataFrame) -> DataFrame:
    """Notes kept as evidence because no page matches."""
    return notes.join(mapped.select(F.col("note").alias("path")).distinct(), "path", "left_anti").withColumn(
        "reason", F.lit("no-canonical-page-match")
    )


def candidate_pages(requested: DataFrame, hits: DataFrame, mapped: DataFrame) -> DataFrame:
    """Ordered distinct union of requested pages, page hits and mapped pages: path, ordinal.

    ``requested``: ordinal, path; ``hits`` from :func:`resolve_hits`; ``mapped`` from
    :func:`map_notes`.  The ordinal is (source, rank, page) of the first appearance.
    """
    note_rank = hits.where("family = 'raw' AND first").select(F.col("path").alias("note"), "rank")
    rows = (
        requested.select("path", F.lit(0).alias("source"), F.col("ordinal").cast("bigint").alias("rank"))
        .unionByName(
            hits.where("family = 'wiki' AND first").select(
                "path", F.lit(1).alias("source"), F.col("rank").cast("bigint").alias("rank")
            )
        )
        .unionByName(
            mapped.join(note_rank, "note").select(
                F.col("page").alias("path"), F.lit(2).alias("source"), F.col("rank").cast("bigint").alias("rank")
            )
        )
    )
    return rows.groupBy("path").agg(F.min(F.struct("source", "rank")).alias("o")).select(
        "path", F.struct("o.source", "o.rank", "path").alias("ordinal")
    )
