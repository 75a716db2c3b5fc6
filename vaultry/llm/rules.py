"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit, its measurement is kept.

Policies are versioned masks over the bits.  Changing a policy, or asking what a rule costs, reads the ledger alone; no text
is read or measured again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import plain_offsets, text_slices, texts_of, trimmed, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` is set where ``fails`` (SQL over the measures) holds."""

    name: str
    bit: int
    fails: str


#: All comparisons are between whole numbers, so every engine decides alike.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", 2, "10 * n_symbols > 5 * n_words"),
    Rule("repeated_lines", 3, "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", 4, "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    Rule("mostly_capitals", 6, "10 * n_caps > 4 * word_chars"),
)
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version's rejecting rules.  The base rules belong to every version."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in {*BASE, *self.rules})


POLICIES = (
    Policy(1, ()),
    Policy(2, ("many_symbols", "repeated_lines", "short_words", "long_words", "mostly_capitals")),
)
CURRENT = POLICIES[-1]


def _repeated(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By text: words that lie in a window of five words that the text has twice or more."""
    texts = len(counts)
    of = np.repeat(np.arange(texts), counts)
    span = len(codes) - WINDOW + 1
    if span <= 0:
        return np.zeros(texts, np.int64)
    inside = of[:span] == of[WINDOW - 1 :]
    # windows are numbered exactly, by pairs of pairs and the fifth word
    pairs = pd.factorize(codes[:-1] * (codes.max() + 1) + codes[1:])[0].astype(np.int64)
    fours = pd.factorize(pairs[:-2] * (pairs.max() + 1) + pairs[2:])[0].astype(np.int64)
    fives = pd.factorize(fours[:span] * (codes.max() + 1) + codes[WINDOW - 1 :])[0].astype(np.int64)
    at = np.flatnonzero(inside)
    windows = pd.factorize(fives[at] * texts + of[at])[0]
    twice = at[np.bincount(windows)[windows] > 1]
    covered = np.zeros(len(codes) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    return np.bincount(of[np.cumsum(covered)[:-1] > 0], minlength=texts)


def _line_measures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """By text: lines with a word, and those equal to an earlier line of the text."""
    lines = pc.split_pattern(texts, "\n")
    bounds = plain_offsets(lines)
    flat = lines.flatten()
    full = np.asarray(pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]"))
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))[full]
    codes = np.asarray(flat.dictionary_encode().indices, np.int64)[full]
    again = pd.Series(codes * len(texts) + of).duplicated().to_numpy()
    return np.bincount(of, minlength=len(texts)), np.bincount(of[again], minlength=len(texts))


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text."""
    words, counts = words_of(texts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    chars = np.concatenate(([0], np.cumsum(np.asarray(pc.utf8_length(words), np.int64))))
    codes = np.asarray(words.dictionary_encode().indices, np.int64)
    n_lines, n_dup_lines = _line_measures(texts)
    return {
        "n_words": counts, "word_chars": np.diff(chars[starts]),
        "n_symbols": np.asarray(pc.count_substring_regex(texts, r"[#*$%&|<>]"), np.int64),
        "n_dup_lines": n_dup_lines, "n_repeat_words": _repeated(codes, counts), "n_lines": n_lines,
        "n_caps": np.asarray(pc.count_substring_regex(texts, r"[A-Z]"), np.int64),
    }


def failure_bits() -> Column:
    """The rules' bits as one number."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, the measures and ``failed_bits`` of every row; no shuffle.

    Words are runs without ASCII white space of the whole text.  A NULL text counts as the empty one: no words, so it
    fails ``few_words``.  Equal rows give equal rows.  Columns that are not carried are not read; a carried one may
    have any name that is no measure.  An empty table gives an empty ledger.
    """
    others = [c for c in carry if c != text]
    packed = docs.select(F.struct(*(others or [F.lit(0).alias("none")])).alias("row"), F.col(text).alias("text"))
    whole = len(others) < len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = measured(texts_of(part))
                kept = {c: part.column(c) for c in (("row", "text") if whole else ("row",))}
                yield pa.RecordBatch.from_pydict(kept | {k: pa.array(found[k].astype(np.int64)) for k in MEASURES})

    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + "text string, " * whole + ", ".join(f"{m} long" for m in MEASURES)
    out = packed.mapInArrow(trimmed(run), schema)
    columns = [(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in carry]
    return out.select(*columns, *MEASURES).withColumn("failed_bits", failure_bits())


def verdicts(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """``rows`` of a ledger plus ``policy``, ``base_failed`` and ``kept``."""
    base = Policy(0, ()).mask
    return rows.select(
        "*", F.lit(policy.version).alias("policy"), (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"),
        (F.col("failed_bits").bitwiseAND(policy.mask) == 0).alias("kept"),
    )


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """What every rule of every policy costs, from the bits alone.

    ``policy, rule, n_docs, n_failed`` (the rule's bit is set), ``n_only`` (no other rule of the policy rejects: kept without
    the rule) and ``n_rejected`` (by the policy).  The ledger is reduced to its different bit patterns, at most two to the
    number of rules, before anything is compared.  An empty ledger gives no rows.
    """
    patterns = rows.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = [
        F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r.name).alias("rule"),
                 F.lit(1 << r.bit).cast("long").alias("bit"))
        for p in policies for r in RULES if p.mask >> r.bit & 1
    ]
    each = patterns.select("failed_bits", "n", F.inline(F.array(*cases)))
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.col("failed_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )
