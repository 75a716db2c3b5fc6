"""Suitability of a canonical block for a question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _word_pattern(words: list[str]) -> str:
    return rf"(?iU)\b(?:{'|'.join(words)})\b"


def query_intent(question: Column) -> Column:
    return (
        F.when(question.rlike(_word_pattern(vocab.CHANGE_WORDS)), "change")
        .when(question.rlike(_word_pattern(vocab.HISTORY_WORDS)), "history")
        .otherwise("current")
    )


def _lookup(c: Column, table: dict, default) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


def known_status(status: Column) -> Column:
    return F.coalesce(F.when(status != "", status), F.lit("unknown"))


def score(status: Column, confidence: Column, intent: Column) -> Column:
    status = known_status(status)
    by_intent = (
        F.when(intent == "history", _lookup(status, vocab.STATUS_SCORES["history"], 0))
        .when(intent == "change", _lookup(status, vocab.STATUS_SCORES["change"], 0))
        .otherwise(_lookup(status, vocab.STATUS_SCORES["current"], 0))
    )
    return by_intent + _lookup(confidence, vocab.CONFIDENCE_SCORES, 0)


def check_month(checked: Column) -> Column:
    """Months since year zero; 0 when there is no valid date."""
    day = F.try_to_date(F.substring(checked, 1, 10), "yyyy-M-d")
    return F.coalesce(F.year(day) * 12 + F.month(day), F.lit(0))


def action(status: Column, quality: Column, intent: Column) -> Column:
    status = known_status(status)
    history = (
        F.when(status.isin("historical", "superseded"), "prefer")
        .when(status == "current", "current-context")
        .otherwise("rank-lower-explain")
    )
    change = F.when(
        status.isin("current", "historical", "superseded", "stale"), "compare"
    ).otherwise("rank-lower-explain")
    current = (
        F.when(status == "current", "prefer")
        .when(status == "superseded", "do-not-use-as-current")
        .when(status.isin("historical", "stale", "disputed"), "rank-lower-explain")
        .otherwise("verify-before-using")
    )
    return (
        F.when(quality == vocab.MINIMAL_QUALITY, "use-as-page-caution")
        .when(intent == "history", history)
        .when(intent == "change", change)
        .otherwise(current)
    )


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def note(
    status: Column, confidence: Column, observed: Column, checked: Column, quality: Column,
    superseded_by: Column, evidence_latest: Column, review_mode: Column, intent: Column,
) -> Column:
    """One-sentence explanation of how to use the block."""
    status, confidence = known_status(status), known_status(confidence)
    dates = F.concat_ws(
        ", ",
        F.when(_some(observed), F.concat(F.lit("observed "), observed)),
        F.when(_some(checked), F.concat(F.lit("checked "), checked)),
    )
    dates = F.when(dates == "", "no dates recorded").otherwise(dates)
    tail = F.concat(F.lit("; "), confidence, F.lit(" confidence; "), dates, F.lit("."))
    successor = F.when(
        _some(superseded_by), F.concat(F.lit(" Superseded by "), superseded_by, F.lit("."))
    ).otherwise("")
    minimal = F.concat(
        F.lit("Minimal page-level freshness stamp only;"),
        F.when(
            _some(evidence_latest),
            F.concat(F.lit(" latest related evidence "), evidence_latest, F.lit(";")),
        ).otherwise(""),
        F.when(_some(review_mode), F.concat(F.lit(" review mode "), review_mode, F.lit(";"))).otherwise(""),
        F.lit(" detailed page claims are not yet block-mapped"),
        tail,
    )
    history = (
        F.when(status == "historical", F.concat(F.lit("historical block"), tail))
        .when(
            status == "superseded",
            F.concat(F.lit("Superseded block remains useful for history"), tail, successor),
        )
        .otherwise(
            F.concat(status, F.lit(" block used as supporting context for a history query"), tail)
        )
    )
    change = F.concat(status, F.lit(" block can be compared in a change-over-time answer"), tail)
    current = (
        F.when(status == "current", F.concat(F.lit("current block"), tail))
        .when(
            status == "historical",
            F.concat(F.lit("historical block; rank lower for current-state answers"), tail),
        )
        .when(
            status == "stale",
            F.concat(F.lit("Stale block; rank lower and explain freshness uncertainty"), tail),
        )
        .when(
            status == "disputed",
            F.concat(F.lit("Disputed block; do not present without explaining the dispute"), tail),
        )
        .when(
            status == "superseded",
            F.concat(F.lit("Superseded block; do not use as the current answer"), tail, successor),
        )
        .otherwise(
            F.concat(
                F.lit("Freshness is "), status,
                F.lit("; verify before using for a current-state answer"), tail,
            )
        )
    )
    return (
        F.when(quality == vocab.MINIMAL_QUALITY, minimal)
        .when(intent == "history", history)
        .when(intent == "change", change)
        .otherwise(current)
    )
