"""Path arithmetic on strings with ``/`` separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, vocab


def parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))


def tidy(c: Column) -> Column:
    """Collapse repeated slashes, ``.`` components and a trailing slash; ``..`` is kept."""
    return F.concat(F.when(c.startswith("/"), F.lit("/")).otherwise(""), F.array_join(parts(c), "/"))


def resolved(c: Column) -> Column:
    """``tidy`` that also folds ``..``; NULL when the path climbs above its root."""
    # a path without empty and dotted components is left as it is
    return F.when(~c.rlike(r"(?:\A|/)(?:\.\.?)?(?:/|\z)"), c).otherwise(text.let(c, _resolved))


def _resolved(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts(c),
        F.struct(empty.alias("kept"), F.lit(False).alias("escaped")),
        lambda acc, p: F.when(
            p == "..",
            F.struct(
                F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0))).alias("kept"),
                (acc["escaped"] | (F.size(acc["kept"]) == 0)).alias("escaped"),
            ),
        ).otherwise(
            F.struct(
                F.concat(acc["kept"], F.array(p)).alias("kept"), acc["escaped"].alias("escaped")
            )
        ),
    )
    climbed = text.let(
        folded, lambda state: F.when(~state["escaped"], F.array_join(state["kept"], "/"))
    )
    return F.when(c.contains(".."), climbed).otherwise(F.array_join(parts(c), "/"))


def name(c: Column) -> Column:
    # a pattern that ends at the end is tried at every character; only slashes at the end need it
    return F.when(c.endswith("/"), F.regexp_extract(c, r"([^/]*)/*\z", 1)).otherwise(F.substring_index(c, "/", -1))


def parent(c: Column) -> Column:
    """Directory part, empty for a bare name."""
    cut = F.left(c, F.length(c) - F.length(F.substring_index(c, "/", -1)) - 1)
    return F.when(c.endswith("/"), F.regexp_replace(c, r"/?[^/]*/*\z", "")).otherwise(cut)


def suffix(c: Column) -> Column:
    """Extension with its dot; names that only start with a dot have none."""
    return F.regexp_extract(name(c), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(name(c), r"(?s)(?<=.)\.[^.]+\z", "")


def known_extension(c: Column) -> Column:
    return F.lower(suffix(c)).isin(vocab.LINKABLE_EXTENSIONS)


def drop_md(c: Column) -> Column:
    return F.regexp_replace(c, r"\.md\z", "")


def trailing_paths(c: Column) -> Column:
    """Every trailing run of components, the whole path first."""

    def runs(components: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(components)),
            lambda i: F.array_join(F.slice(components, i, F.size(components)), "/"),
        )

    return text.let(F.split(c, "/"), runs)


def component_order(c: Column) -> Column:
    """Sort key that compares component by component instead of character by character."""
    return F.translate(c, "/", "\u0001")


def kind(c: Column) -> Column:
    """Second component of a page path, ``wiki`` when there is none."""
    p = parts(c)
    return F.when((F.size(p) >= 2) & (F.get(p, F.lit(0)) == "wiki"), F.get(p, F.lit(1))).otherwise("wiki")


def truncated(c: Column, max_len: int = 40, prefix_len: int = 20) -> Column:
    tail = max_len - prefix_len - 3
    if tail <= 0:
        short = F.substring(c, 1, max_len)
    else:
        short = F.concat(F.substring(c, 1, prefix_len), F.lit("..."), F.right(c, F.lit(tail)))
    return F.when(F.length(c) <= max_len, c).otherwise(short)


def is_scanned_page(c: Column) -> Column:
    """Markdown files a vault scan looks at: below wiki/ or raw/, not hidden, not navigation."""
    return (
        c.endswith(".md")
        & c.rlike(r"\A(?:wiki|raw)/")
        & ~c.rlike(r"(?:\A|/)\.[^/]*/")
        & ~name(c).isin(vocab.NAVIGATION_NAMES)
        & (c != "wiki/log.md")
    )


def in_resources(c: Column) -> Column:
    return F.exists(parts(c), lambda p: (p == "_resources") | p.endswith(".resources"))


def url_decoded(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and stray ``%`` alone."""
    safe = F.replace(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(c.contains("%"), F.url_decode(safe)).otherwise(c)
