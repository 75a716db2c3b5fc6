"""Texts that hold a run of words of a reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word.
_WORD = r"[^\x20\x09-\x0D]+"


def runs(content: Column, size: int) -> Column:
    """Digests of every run of ``size`` words in a text; none for shorter and NULL texts."""
    words = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(_WORD), F.lit(0))

    def digests(w: Column) -> Column:
        places = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.md5(F.array_join(F.slice(w, i, F.lit(size)), " ").cast("binary")))

    # the words are found once and bound, so that a run does not look for them again
    return F.array_distinct(F.flatten(F.transform(F.array(words), digests)))


def holders(texts: DataFrame, key: str, content: str, reference: DataFrame, reference_content: str, size: int = 13) -> DataFrame:
    """Distinct keys of texts that share a run of ``size`` words with ``reference``.

    The reference's runs are distinct; where they are few Spark sends them to the texts, otherwise both sides meet by digest.
    """
    wanted = reference.select(F.explode(runs(F.col(reference_content), size)).alias("_run")).distinct()
    own = texts.select(key, F.explode(runs(F.col(content), size)).alias("_run"))
    return own.join(wanted, "_run", "left_semi").select(key).distinct()
