"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and SQL functions alone.

A text is cut at its candidates, so the pieces between them are the candidates' neighbourhoods, and a text with secrets taken out is the
pieces put together again.  The forest is trained by Spark's machine-learning library on labelled findings and then written as SQL
conditions, which are evaluated inside the row: texts are never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod5, highest, stored

#: A run of 12 or more characters of keys and hashes, with a digit in it; '=' is padding at its end.  Parts of 12 or more behind dots belong
#: to it.  What an '=' and a value follow is a name, so the value begins behind it, unless the run is a value itself.
_RUN = r"(?=[A-Za-z+/_-]{0,256}[0-9])(?=[A-Za-z0-9+/_=-]{12})[A-Za-z0-9+/_-]{10,}+(?:\.[A-Za-z0-9_-]{12,}+)*+(?:=++(?![A-Za-z0-9+/_-]))?+"
CANDIDATE = rf"(?:(?<==){_RUN}|(?<![A-Za-z0-9+/_=-]){_RUN}(?!=))"
MASK = "[SECRET]"
#: Words that name credentials, and words that name other numbers.
_KEYS = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer|private)[A-Za-z0-9_]*[\x22'\s]*[:=]?[\x22'\s]*$"
_OTHERS = r"(?i)(card|order|invoice|isbn|phone|tel|iban|uuid|checksum|commit|version|build|ticket)[A-Za-z_]*[\x22'\s#.]*[:=]?[\x22'\s]*$"

FEATURES = {
    "length": "length(c.value)",
    "digits": "regexp_count(c.value, '[0-9]') / length(c.value)",
    "uppers": "regexp_count(c.value, '[A-Z]') / length(c.value)",
    "hex": "regexp_count(c.value, '[0-9A-Fa-f]') / length(c.value)",
    "signs": "regexp_count(c.value, '[+/_=-]') / length(c.value)",
    "transitions": "(regexp_count(c.value, '[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+') - 1) / (length(c.value) - 1)",
    "rises": "regexp_count(c.value, '[a-z][A-Z]|[A-Za-z][0-9]') / (length(c.value) - 1)",
    "different": "size(array_distinct(split(c.value, ''))) / length(c.value)",
    "coverage": "1 - length(regexp_replace(lower(c.value), '{words}', '')) / length(c.value)",
    "path": r"CAST(c.value LIKE '%/%' OR c.before RLIKE '[/\\\\.@:]$' OR c.after RLIKE '^[/\\\\.@:]' AS INT)",
    "assigned": r"""CAST(c.before RLIKE '[:=]\\s*["\']?$' AS INT)""",
    "quoted": r"""CAST(c.before RLIKE '["\']$' AND c.after RLIKE '^["\']' AS INT)""",
    "key_word": "CAST(c.before RLIKE '{keys}' AS INT)",
    "other_word": "CAST(c.before RLIKE '{others}' AS INT)",
    "word_before": r"length(regexp_extract(c.before, '([A-Za-z]*)[^A-Za-z]*$', 1))",
    "word_after": r"length(regexp_extract(c.after, '^[^A-Za-z]*([A-Za-z]*)', 1))",
}


@dataclass(frozen=True)
class Settings:
    """``max_findings`` different labelled findings of each label (a sample by hash) bound the training set."""

    max_findings: int = 10_000
    trees: int = 20
    depth: int = 5
    dictionary_words: int = 1_000
    seed: int = 7


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def dictionary(docs: DataFrame, text: str = "text", words: int = Settings.dictionary_words) -> list[str]:
    """The most frequent words of 4 to 12 letters a-z in all documents."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9])[a-z]{4,12}(?![a-z0-9])"), 0)).alias("w"))
    top = highest(stored(found.groupBy("w").count().where("count > 1"), "secret-words"), "count", words)
    return [r.w for r in top.orderBy(F.desc("count"), "w").select("w").collect()]


def _cut(text: str) -> tuple[Column, Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.split(whole, CANDIDATE, -1), F.regexp_extract_all(whole, F.lit(CANDIDATE), 0)


def with_candidates(docs: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """``docs`` plus ``_parts`` (text between the candidates) and ``_found``: a struct of every candidate and its features."""
    parts, values = _cut(text)
    near = 80  # characters of the neighbourhood that the patterns look at
    kinds = {
        "words": _quoted("|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"), "keys": _quoted(_KEYS), "others": _quoted(_OTHERS),
    }
    features = [
        f"CAST({sql.format(**kinds) if name in ('coverage', 'key_word', 'other_word') else sql} AS DOUBLE) AS {name}"
        for name, sql in FEATURES.items()
    ]
    cut = docs.withColumns({"_parts": parts, "_values": values})
    around = cut.withColumn(
        "_near",
        F.transform("_values", lambda v, i: F.struct(
            v.alias("value"), F.right(F.get("_parts", i), F.lit(near)).alias("before"),
            F.left(F.get("_parts", i + 1), F.lit(near)).alias("after"), (i + 1).alias("nth"),
        )),
    )
    return around.withColumn(
        "_found", F.expr(f"transform(_near, c -> struct(c.value, c.before, c.after, c.nth, {', '.join(features)}))")
    ).drop("_near", "_values")


def seed_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where the neighbourhood leaves no doubt: ``secret`` 1 or 0; others are left out.

    1: a value of 20 or more characters that is assigned to a key word, with letters and digits.  0: digits alone, or no key word
    and nothing assigned.  A reviewed table of findings with the same columns may be used in its place.
    """
    sure = F.expr(
        "CASE WHEN key_word = 1 AND (assigned = 1 OR quoted = 1) AND length >= 20 AND digits < 1 THEN 1D "
        "WHEN digits = 1 OR (key_word = 0 AND assigned = 0) THEN 0D END"
    )
    return found.withColumn("secret", sure).where("secret IS NOT NULL")


def train(labelled: DataFrame, settings: Settings = Settings()) -> str:
    """SQL for the share of trees that call a finding ``c`` a secret.

    With labels of one kind, or none, the score is that label, or 0.5: then nothing is removed or reported without cause.
    """
    columns = list(FEATURES)
    different = labelled.select("secret", "value", "before", "after", *columns).distinct()
    sides = [bounded_sample(different.where(f"secret = {k}"), ["value", "before", "after"], settings.max_findings) for k in (0, 1)]
    sides = [side.select("secret", *columns) for side in sides]
    rows = stored(sides[0].unionByName(sides[1]).repartition(1).sortWithinPartitions("secret", *columns), "secret-train")
    kinds = sorted(r.secret for r in rows.select("secret").distinct().collect())
    if len(kinds) < 2:
        return f"{kinds[0]}D" if kinds else "0.5D"
    forest = RandomForestClassifier(
        labelCol="secret", featuresCol="features", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed,
        featureSubsetStrategy="sqrt", minInstancesPerNode=2,
    )
    model = forest.fit(VectorAssembler(inputCols=columns, outputCol="features").transform(rows))
    return forest_sql(model.toDebugString, columns)


def forest_sql(description: str, columns: list[str]) -> str:
    """The forest as the mean of CASE expressions, from the library's description of its trees."""
    lines = [line.strip() for line in description.splitlines()]
    trees, at = [], 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return f"{float(line.partition(':')[2])}D"
        feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        if not lines[at].startswith("Else"):
            raise ValueError(f"unknown description of a tree: {lines[at]}")
        at += 1
        return f"CASE WHEN c.{columns[int(feature)]} <= {float(limit)!r}D THEN {yes} ELSE {node()} END"

    while at < len(lines):
        if lines[at].startswith("Tree"):
            at += 1
            trees.append(node())
        else:
            at += 1
    return f"({' + '.join(trees)}) / {len(trees)}"


def _scored(docs: DataFrame, words: list[str], score: str, text: str) -> DataFrame:
    return with_candidates(docs, words, text).withColumn(
        "_found", F.expr(f"transform(_found, c -> struct(c.value, c.nth, c.key_word, c.coverage, {score} AS score))")
    )


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> tuple[list[str], str]:
    """Dictionary and forest from all documents; labels come from those outside the held-out fold."""
    words = dictionary(docs, text, settings.dictionary_words)
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(crc_mod5("doc_id") != 0)
    found = with_candidates(narrow.select("text"), words).select(F.inline("_found"))
    return words, train(seed_labels(stored(found, "secret-findings")), settings)


def findings(docs: DataFrame, model: tuple[list[str], str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, nth, length, key_word, coverage, score, is_secret, value_sha256`` of every candidate in every whole text.

    ``nth`` counts the candidates of a row's text from 1.  NULL and empty texts have none.  Repeated rows give repeated
    findings.  Other columns are not read.  An empty table gives an empty result.
    """
    words, score = model or fit(docs, text=text, key=key)
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = _scored(narrow, words, score, "text").select("doc_id", F.inline("_found"))
    return rows.select(
        "doc_id", "nth", F.length("value").alias("length"), F.col("key_word").cast("int").alias("key_word"), "coverage", "score",
        (F.col("score") >= 0.5).alias("is_secret"), F.sha2("value", 256).alias("value_sha256"),
    )


def masked(docs: DataFrame, model: tuple[list[str], str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with every secret of the text replaced by ``MASK``; texts without secrets are unchanged, NULL stays NULL."""
    words, score = model or fit(docs, text=text, key=key)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    cut = _scored(packed, words, score, "_text")
    pieces = F.expr(
        f"array_join(transform(_parts, (p, i) -> concat(p, CASE WHEN i < size(_found) THEN "
        f"CASE WHEN get(_found, i).score >= 0.5 THEN '{MASK}' ELSE get(_found, i).value END ELSE '' END)), '')"
    )
    clean = F.when(F.exists("_found", lambda c: c["score"] >= 0.5), pieces).otherwise(F.col("_text"))
    return cut.select("_row", clean.alias("_clean")).select(
        *[(F.col("_clean") if c == text else F.col("_row")[c]).alias(c) for c in docs.columns]
    )
