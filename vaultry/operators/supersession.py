"""Pages that replace other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, paths, text, vocab
from ..session import checkpointed

# Links, and phrases that speak of a replacement.
_LINK = r"\[\[([^\]]+)\]\]"
_PHRASE = r"(?iU)\b(" + "|".join(vocab.SUPERSESSION_PHRASES) + r")\b"


def declared(pages: DataFrame, key: str) -> DataFrame:
    """Targets a page names under ``key``: path, position, target; one row per list item.

    ``position`` is NULL for pages that carry the key without any target.
    """
    def values(lines: Column) -> Column:
        head = rf"(?iU)\A{key}[\s\x1c-\x1f]*:[\s\x1c-\x1f]*(.*)\z"
        marks = F.transform(lines, lambda l, i: F.when(l.rlike(head), i))

        def at(last: Column) -> Column:
            inline = text.strip(F.regexp_extract(F.get(lines, last), head, 1))
            rest = F.slice(lines, last + 2, F.size(lines))
            is_item = F.transform(rest, lambda l: l.rlike(r"(?U)\A[\s\x1c-\x1f]*-[\s\x1c-\x1f]+"))
            stop = F.array_position(is_item, F.lit(False)).cast("int")
            items = F.transform(
                F.slice(rest, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(rest))),
                lambda l: text.strip(F.regexp_replace(l, r"(?U)\A[\s\x1c-\x1f]*-[\s\x1c-\x1f]+", "")),
            )
            return F.when(inline == "", items).otherwise(F.array(inline))

        return text.let(F.array_max(marks), at)

    def target(value: Column) -> Column:
        named = F.coalesce(text.find(value, _LINK, 1), value)
        return text.strip(F.substring_index(named, "|", 1))

    rows = pages.where(F.lower("content").contains(key)).select(
        "path",
        text.let(text.lines(frontmatter.dates_block(F.col("content"))), values).alias("_values"),
    ).where("_values IS NOT NULL")
    return rows.select(
        "path",
        F.posexplode_outer(
            F.filter(F.transform("_values", target), lambda t: t != "")
        ).alias("position", "target"),
    )


def resolve(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges plus ``resolved`` page and ``outcome`` (resolved / ambiguous / dangling).

    The exact path wins, else the only page of that stem without regard to case.
    """
    wanted = edges.where("target IS NOT NULL").select("target").distinct()
    exact = wanted.withColumn(
        "path",
        F.when(F.col("target").endswith(".md"), F.col("target")).otherwise(F.concat("target", F.lit(".md"))),
    ).join(pages.select("path"), "path").select("target", F.col("path").alias("_exact"))
    stems = pages.groupBy(F.lower(paths.stem(F.col("path"))).alias("_stem")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("path").alias("_only")
    )
    found = (
        wanted.withColumn("_stem", F.lower(paths.stem(F.col("target"))))
        .join(exact, "target", "left")
        .join(stems, "_stem", "left")
        .select(
            "target",
            F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_only"))).alias("resolved"),
            F.when(F.col("_exact").isNotNull() | (F.col("_n") == 1), "resolved")
            .when(F.col("_n") > 1, "ambiguous").otherwise("dangling").alias("outcome"),
        )
    )
    return edges.join(found, "target", "left")


def missing_reciprocal(superseded_by: DataFrame, supersedes: DataFrame) -> DataFrame:
    """Resolved edges whose target does not name the source back: path, resolved."""
    forward = superseded_by.where("outcome = 'resolved'").select("path", "resolved").distinct()
    back = supersedes.where("outcome = 'resolved'").select(
        F.col("path").alias("resolved"), F.col("resolved").alias("path")
    ).distinct()
    return forward.join(back, ["path", "resolved"], "left_anti")


def endless(successors: DataFrame) -> DataFrame:
    """Pages (path, next) whose chain never ends: members of rings and the pages that lead into one.

    Every page points at the page 1, 2, 4, ... steps on; those whose pointer leaves the table are gone.  A row is two paths at any length of
    chain.  While a finite chain is left, its page of just so many steps goes, so a round in which none goes is the last.
    """
    pointers = checkpointed(successors.select("path", F.col("next").alias("far")))
    left = pointers.count()
    while left:
        onward = pointers.select(F.col("path").alias("far"), F.col("far").alias("_further"))
        pointers = checkpointed(pointers.join(onward, "far").select("path", F.col("_further").alias("far")))
        before, left = left, pointers.count()
        if left == before:
            break
    return successors.join(pointers.select("path"), "path", "left_semi")


def cycles(superseded_by: DataFrame, max_chain: int | None = None) -> DataFrame:
    """Pages whose chain of first successors runs into itself: path, cycle (and ``truncated`` with ``max_chain``).

    Pages whose chain ends are left out first (:func:`endless`).  The other chains are doubled by self-joins until each
    repeats a page, so a chain of any length takes as many rounds as its length has binary digits, and what is held is what is
    returned.  ``max_chain`` limits the walk to so many successors; walks that
    are longer are then returned with ``truncated`` and no cycle.
    """
    first = superseded_by.where("outcome = 'resolved'").groupBy("path").agg(
        F.min_by("resolved", "position").alias("next")
    )
    if max_chain is None:
        first = endless(checkpointed(first))
    walk = F.concat(F.array("path"), F.col("steps"))
    repeats = F.size(F.array_distinct(walk)) < F.size(walk)
    # each round reads the table twice, so it is materialised first
    chains = checkpointed(first.select("path", F.array("next").alias("steps"), F.lit(True).alias("open")))
    steps = 1
    while (max_chain is None or steps < max_chain) and not chains.where("open").isEmpty():
        onward = chains.select(F.col("path").alias("_end"), F.col("steps").alias("_more"))
        doubled = chains.withColumn("_end", F.when(F.col("open"), F.element_at("steps", -1))).join(onward, "_end", "left")
        grown = doubled.select(
            "path", F.concat("steps", F.coalesce("_more", F.array().cast("array<string>"))).alias("steps"),
            F.col("_more").isNotNull().alias("_grew"),
        )
        chains = checkpointed(grown.select("path", "steps", (F.col("_grew") & ~repeats).alias("open")))
        steps *= 2
    cut = walk if max_chain is None else F.slice(walk, 1, max_chain + 1)
    walked = chains.select("path", cut.alias("walk"), (F.col("open") if max_chain is None else F.size(walk) > max_chain + 1).alias("truncated"))
    # position of the first page met again
    seen = F.transform("walk", lambda n, i: F.when(F.array_position(F.col("walk"), n) <= i, i))
    found = walked.withColumn("_at", F.array_min(seen)).withColumn(
        "cycle", F.when(F.col("_at").isNotNull(), F.array_join(F.slice("walk", F.lit(1), F.col("_at") + 1), " -> "))
    )
    if max_chain is None:
        return found.where("cycle IS NOT NULL").select("path", "cycle")
    return found.where("cycle IS NOT NULL OR truncated").select("path", "cycle", (F.col("cycle").isNull()).alias("truncated"))


def body_candidates(pages: DataFrame, declared_paths: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """First body line of a page that speaks of its replacement: path, phrase, guess, context.

    Fences, headings, table rows and phrases hugged by inline code do not count, nor lines whose
    remainder names the page itself.  Guesses still have to be resolved, see
    :func:`without_self_guesses`; ``ordinal`` orders the hits of a page.
    """
    rows = pages.join(declared_paths.select("path").distinct(), "path", "left_anti")
    if ignored is not None:
        rows = rows.join(ignored, "path", "left_anti")
    body = text.outside_fences(text.lines(frontmatter.dates_body(F.col("content"))))
    hits = rows.where(F.col("content").rlike(_PHRASE)).select(
        "path", F.posexplode_outer(F.split(body, "\n")).alias("ordinal", "line")
    ).where(F.col("line").rlike(_PHRASE) & ~text.strip(F.col("line")).rlike(r"\A[#|]"))
    phrase = F.regexp_extract("line", _PHRASE, 1)
    before = F.regexp_substr("line", F.lit(rf"(?s)\A.*?(?={_PHRASE})"))
    placed = hits.select(
        "path", "ordinal", "line", phrase.alias("phrase"), F.length(F.coalesce(before, F.lit(""))).alias("_at")
    ).withColumn("_after", F.substring("line", F.col("_at") + F.length("phrase") + 1, F.length("line")))
    start = F.greatest(F.col("_at") - 3, F.lit(0))
    around = F.substring("line", start + 1, F.col("_at") + F.length("phrase") + 3 - start)
    own = F.lower(paths.stem(F.col("path")))
    return placed.where(~around.contains("`") & ~F.lower("_after").contains(own)).select(
        "path", "ordinal", "phrase",
        text.strip(F.substring_index(F.regexp_extract("_after", _LINK, 1), "|", 1)).alias("guess"),
        text.strip(F.col("line")).alias("context"),
        F.when(F.col("path").rlike(r"\Awiki/[^/]+/"), F.split("path", "/")[1]).otherwise("?").alias("topic"),
    )


def without_self_guesses(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop guesses that resolve to the page itself and keep the first hit per page."""
    guesses = candidates.select(text.present(F.col("guess")).alias("target")).distinct()
    found = resolve(guesses, pages)
    joined = candidates.join(
        found.select(F.col("target").alias("guess"), "resolved", "outcome"), "guess", "left"
    )
    same_stem = F.lower(paths.stem(F.col("guess"))) == F.lower(paths.stem(F.col("path")))
    itself = F.coalesce(F.col("resolved") == F.col("path"), F.lit(False)) | F.coalesce(
        (F.col("outcome") == "ambiguous") & same_stem, F.lit(False)
    )
    return joined.where(~itself).groupBy("path").agg(
        F.min_by(F.struct("phrase", "guess", "context", "topic"), "ordinal").alias("c")
    ).select("path", "c.*")


def queue_order() -> list[Column]:
    """Guessed successors first, then topic relevance, then path."""
    priority = F.lit(9)
    for topic, rank in vocab.TOPIC_PRIORITY.items():
        priority = F.when(F.col("topic") == topic, rank).otherwise(priority)
    return [F.col("guess") == "", priority, F.col("path")]


def counters(superseded_by: DataFrame, supersedes: DataFrame) -> DataFrame:
    """One row: pages with either key, dangling and ambiguous targets, missing back links, cycles."""
    # several counters read the edges; the pages are parsed for them once
    superseded_by = checkpointed(superseded_by.select("path", "position", "resolved", "outcome"))
    supersedes = checkpointed(supersedes.select("path", "resolved", "outcome"))
    base = superseded_by.agg(
        F.countDistinct("path").alias("pages_superseded"),
        F.count_if(F.col("outcome") == "dangling").alias("dangling"),
        F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"),
    )

    def rows(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return base.withColumns(
        {
            "pages_superseding": rows(supersedes.select("path").distinct()),
            "missing_reciprocal": rows(missing_reciprocal(superseded_by, supersedes)),
            "cycles": rows(cycles(superseded_by)),
        }
    )
