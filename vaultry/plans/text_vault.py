"""The supplied tables written out as Markdown, one document per row.

Nothing is grouped to build a document, so no key decides how large one becomes.  The expected
results follow directly from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..sources.tables import table
from .projection import KINDS, choose, part_path


def s(c: Column) -> Column:
    return c.cast("string")


def _cat(*pieces) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def block_count() -> Column:
    return (F.col("p_size") % 5).cast("int")


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): front matter, headings, ``p_size % 5`` blocks, a fence and a callout."""
    key, n = F.col("p_partkey"), block_count()
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    title = F.when(key % 3 == 0, _cat('---\ntitle: "', F.col("p_name"), ' sheet"\n# note\n---\n')).otherwise(
        F.when(key % 3 == 1, "---\ntype: part\n---\n").otherwise("")
    )
    heading = F.when(key % 4 == 0, "").otherwise(_cat("# ", F.col("p_brand"), " #\n\n"))
    prose = F.array_join(
        F.transform(
            numbers,
            lambda i: _cat(
                F.when(i == 3, "### Deep part\n").when(i % 2 == 1, "## Facts\n\n").otherwise(""),
                "The ", F.col("p_type"), " costs ", s(i), "\nper unit. ^b", s(i),
                F.when(i == 4, " ^twin\n").otherwise("\n"), F.when(i % 2 == 0, "\n").otherwise(""),
            ),
        ),
        "",
    )
    fence = F.when(key % 2 == 0, "\n```\nsample ^inside\n```\n").otherwise("\n")
    entries = F.array_join(
        F.transform(
            numbers,
            lambda i: _cat(
                ">   b", s(i), ":\n>     status: ", choose(vocab.STATUSES, (key + i) % 7),
                "\n>     confidence: ", F.when(i == 2, "certain").otherwise("high"),
                "\n>     sources: ",
                choose(
                    ["[]", "[raw/a, with comma.md, raw/b.md]", '["raw/q, x.md", \'raw/z.md\']', "[one, two]"],
                    (key + i) % 4,
                ),
                "\n>     observed: 2024-05-1", s(i), "\n>     checked: ",
                F.when(i == 4, "2024-05-02").when(i == 1, "soon").otherwise("2024-06-01"), "\n",
            ),
        ),
        "",
    )
    callout = F.when(
        key % 6 > 0,
        _cat(
            "\n> [!provenance]- Provenance\n> schema: ", F.when(key % 7 == 0, "other").otherwise("kb-prov-v1"),
            "\n> migration_status: ",
            F.when(key % 5 == 0, vocab.MINIMAL_MIGRATION).when(key % 5 == 1, vocab.INFERRED_MIGRATION)
            .otherwise("null"),
            "\n> blocks:\n", entries,
            F.when(key % 9 == 0, ">   ghost:\n>     status: open\n").otherwise(""), "\nAfterword.\n",
        ),
    ).otherwise("")
    return table(spark, sf, "part").select(
        part_path(key).alias("path"),
        _cat(title, heading, "Intro line.\n\n", prose, fence, callout).alias("content"),
    )


def order_links() -> list[tuple[str, str, Column]]:
    """(type, text before and after, target) of the links in an order note."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    part = _cat("Part ", s(customer))
    kind = choose(KINDS, customer % 8)
    return [
        ("wikilink", "See [[{}]] and ", part),
        ("wikilink", "[[{}|alias]].", _cat("wiki/", kind, "/Part ", s(customer))),
        ("image", "\n![[{}]] ", _cat(kind, "/Part ", s(customer), ".md")),
        ("markdown", "[text]({}#anchor)\n", _cat("../../wiki/", kind, "/Part%20", s(customer), ".md")),
        ("wikilink", "- [[{}\\|table]]\n", _cat("Part-", s(customer))),
        ("wikilink", "x [[{}]] y\n", _cat("Part ", s(key))),
        ("markdown", "[web]({})\n", _cat("https://example.com/", s(key))),
        ("image", "![alt]({}) ", _cat("wiki/", kind, "/Part%20", s(key), ".md")),
        ("wikilink", "[[{}]]\n", _cat("Part ", s(customer), " .md")),
    ]


def order_notes(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): one raw note per order with links of every kind."""
    key = F.col("o_orderkey")
    body = [_cat("---\nrelated: ", _cat("[[Part ", s(F.col("o_custkey")), "]]"), "\n---\n")]
    for _, frame, target in order_links():
        before, after = frame.split("{}")
        body.append(_cat(before, target, after))
    body.append(_cat("[[Part ", s(key), "|(broken link) gone]]\n"))
    return table(spark, sf, "orders").select(
        _cat("raw/orders/Order ", s(key), ".md").alias("path"), F.concat(*body).alias("content")
    )


def vault_files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the part pages and the order notes."""
    pages = table(spark, sf, "part").select(part_path(F.col("p_partkey")).alias("path"))
    notes = table(spark, sf, "orders").select(
        _cat("raw/orders/Order ", s(F.col("o_orderkey")), ".md").alias("path")
    )
    return pages.unionByName(notes)
