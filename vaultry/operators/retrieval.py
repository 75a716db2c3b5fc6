"""Lexical and vector search over stored texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import checkpointed

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def question_terms(question: str) -> list[str]:
    """Letters and digits, as in :func:`tokens`; each term once."""
    return sorted(set(re.findall(r"[^\W_]+", question.lower())))


def lexical_index(texts: DataFrame, key: str, content: str) -> DataFrame:
    """Rows (key, doc_length, term, tf) of texts with unique keys; terms are counted within the text's row."""
    rows = texts.select(key, F.sort_array(tokens(F.col(content))).alias("_tokens"))
    # the outer form keeps Spark from adding filters that would cut every text again
    found = rows.select(key, F.size("_tokens").alias("doc_length"), F.explode_outer(_counted(F.col("_tokens"))).alias("c"))
    return found.where("c IS NOT NULL").select(key, "doc_length", "c.term", "c.tf")


def _counted(ordered: Column) -> Column:
    """(term, tf) of the terms in a sorted array."""

    def counted(terms: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.size(terms)), lambda i: ~F.get(terms, i).eqNullSafe(F.get(terms, i - 1))
        )
        return text.let(ends, lambda last: F.transform(last, lambda end, i: F.struct(
            F.get(terms, end - 1).alias("term"), (end - F.coalesce(F.get(last, i - 1), F.lit(0))).cast("bigint").alias("tf")
        )))

    return F.when(F.size(ordered) > 0, text.let(ordered, counted))


def bm25(texts: DataFrame, key: str, content: str, question: str, k: int = 15) -> DataFrame:
    """Top ``k`` texts for a question: key, score.

    Only the question's terms are counted, inside each row; nothing but counts leaves it.
    """
    terms = question_terms(question)

    def counts(found: Column) -> Column:
        def occurrences(term: str) -> Column:
            return F.size(F.filter(found, lambda t: t == term))

        return F.struct(
            F.size(found).alias("_length"), *[occurrences(w).alias(f"_tf{i}") for i, w in enumerate(terms)]
        )

    # the totals and the scores read these few numbers; the texts are read once
    rows = checkpointed(
        texts.select(key, text.let(tokens(F.col(content)), counts).alias("c")).select(key, "c.*")
    )
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("avg"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    facts = totals.select(F.struct("*").alias("s")).scalar()
    score = F.lit(0.0)
    scored = rows.withColumn("_s", facts)
    for i in range(len(terms)):
        tf, df, n = F.col(f"_tf{i}"), F.col(f"_s.df{i}"), F.col("_s.n")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = tf + K1 * (1 - B + B * F.col("_length") / F.col("_s.avg"))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / norm).otherwise(0.0)
    return scored.select(key, F.round(score, 6).alias("score")).where("score > 0").orderBy(
        F.desc("score"), key
    ).limit(k)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, key: str, vector: str, asked: Column, k: int = 15) -> DataFrame:
    """Top ``k`` vectors by cosine similarity to ``asked`` (a literal or scalar subquery)."""
    with_asked = vectors.withColumn("_asked", asked)
    return with_asked.select(
        key, F.round(cosine(F.col(vector), F.col("_asked")), 6).alias("similarity")
    ).orderBy(F.desc("similarity"), key).limit(k)
