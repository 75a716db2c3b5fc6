"""Toxicity by a counterfactually regularised linear classifier.

Words that separate the labels are the features.  In labelled sentences identity terms are swapped for others of their
group and for a neutral placeholder; a difference between the two scores is penalised, so the mere mention of a group
does not move the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, crc_mod5, highest, stored, text_slices, texts_of, trimmed, words_of

#: Groups of terms that may be swapped for one another.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "old", "young"),
)
#: Stands for a term in a sentence and is no feature.
NEUTRAL = "someone"
_EDGES = ".,;:!?\"'`()[]{}<>|#*$%&+=~^_-/\\“”„«»…–—¡¿"
_SENTENCES = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Settings:
    """``max_train`` labelled documents (a sample by hash) and ``max_features`` words bound the driver's part of fitting."""

    max_train: int = 20_000
    max_features: int = 4_000
    min_documents: int = 5
    least_z: float = 4.0
    l2: float = 0.1
    swap_penalty: float = 50.0
    rounds: int = 1000


@dataclass(frozen=True)
class Model:
    words: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0


def _present(texts: pa.Array, features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, feature) of the features that occur in each whole text, sorted by text."""
    words, counts = words_of(pc.utf8_lower(texts))
    coded = words.dictionary_encode()
    of = np.asarray(pc.fill_null(pc.index_in(pc.utf8_trim(coded.dictionary, _EDGES), value_set=features), -1), np.int64)
    found = of[np.asarray(coded.indices, np.int64)] if len(words) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    keys = np.unique(text[found >= 0] * max(len(features), 1) + found[found >= 0])
    return keys // max(len(features), 1), keys % max(len(features), 1)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text, toxic`` of up to ``max_train`` labelled documents outside the held-out fold, stored.

    A document with several labels counts as toxic if one says so.  Rows with a NULL id or label are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_mod5("doc_id") != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(known, ["doc_id"], settings.max_train)  # bounded, so it may be broadcast
    return stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxicity-train")


def _word_counts(rows: DataFrame) -> DataFrame:
    """``word, n_toxic, n_clean``: documents of either label that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                words, counts = words_of(pc.utf8_lower(texts_of(part)))
                if not len(words):
                    continue
                coded = pc.utf8_trim(words, _EDGES).dictionary_encode()
                size = len(coded.dictionary)
                keys = np.unique(np.repeat(np.arange(len(part)), counts) * size + np.asarray(coded.indices, np.int64))
                toxic = np.asarray(part.column("toxic"))[keys // size] > 0
                n = [np.bincount(keys[k] % size, minlength=size) for k in (toxic, ~toxic)]
                yield pa.RecordBatch.from_pydict(
                    {"word": coded.dictionary, "n_toxic": pa.array(n[0]), "n_clean": pa.array(n[1])}
                )

    counted = rows.select("text", "toxic").mapInArrow(trimmed(run), "word string, n_toxic long, n_clean long")
    return counted.where("word <> ''").groupBy("word").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _features(rows: DataFrame, n_toxic: int, n_clean: int, settings: Settings) -> list[str]:
    """The words whose share differs most clearly between the labels, and all identity terms."""
    seen = F.col("n_toxic") + F.col("n_clean")
    p, q, share = F.col("n_toxic") / n_toxic, F.col("n_clean") / n_clean, seen / (n_toxic + n_clean)
    z = (p - q) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    clear = _word_counts(rows).where(seen >= settings.min_documents).select("word", F.abs(z).alias("z"))
    best = highest(clear.where(F.col("z") >= settings.least_z), "z", settings.max_features).orderBy(F.desc("z"), "word")
    terms = dict.fromkeys(t for group in IDENTITY_GROUPS for t in group)
    return [w for w in dict.fromkeys([*(r.word for r in best.select("word").collect()), *terms]) if w != NEUTRAL]


def _swaps(rows: DataFrame) -> list[tuple[str, str, int]]:
    """``term, other, n``: sentences in which the term can be swapped for the other, or for ``NEUTRAL``.

    Two sentences that differ in one swapped term differ in two features, so a count for each pair of terms says all.
    """
    others = {t: [NEUTRAL, *(o for g in IDENTITY_GROUPS if t in g for o in g if o != t)] for g in IDENTITY_GROUPS for t in g}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: dict[tuple[str, str], int] = {}
            for text in batch.column("text").to_pylist():
                for sentence in _SENTENCES.split((text or "").lower()):
                    words = {w.strip(_EDGES) for w in sentence.split()}
                    for term in words & others.keys():
                        for other in others[term]:
                            if other not in words:
                                pairs[term, other] = pairs.get((term, other), 0) + 1
            yield pa.RecordBatch.from_pydict({
                "term": pa.array([t for t, _ in pairs], pa.string()), "other": pa.array([o for _, o in pairs], pa.string()),
                "n": pa.array(list(pairs.values()), pa.int64()),
            })

    found = rows.select("text").mapInArrow(trimmed(run), "term string, other string, n long").groupBy("term", "other").agg(F.sum("n").alias("n"))
    return [(r.term, r.other, r.n) for r in found.orderBy("term", "other").collect()]  # no more rows than pairs of terms


def solve(
    rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_features: int, swaps: list[tuple[int, int, int]], settings: Settings
) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised logistic loss, by accelerated gradient steps from zero.

    ``swaps`` are pairs of features with their sentences; the number ``n_features`` is the placeholder, whose weight stays 0.
    """
    n, n_features = max(len(labels), 1), n_features + 1
    a, b = (np.asarray([s[k] for s in swaps], np.int64) for k in (0, 1))
    share = np.asarray([s[2] for s in swaps], float)
    share = share / max(share.sum(), 1.0) * settings.swap_penalty
    often = np.bincount(columns, minlength=n_features)
    # one step size for each weight: a bound of the curvature along it
    longest = np.bincount(rows, minlength=n).max(initial=1) + 1
    bend = np.bincount(a, share, n_features) + np.bincount(b, share, n_features)
    step = 1.0 / (0.25 * often * np.sqrt(longest) / n + settings.l2 / n + 4 * bend + 1e-9)
    w, shift = np.zeros(n_features), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    ahead, ahead_shift, momentum = w, shift, 1.0
    for _ in range(settings.rounds):
        score = np.bincount(rows, ahead[columns], n) + ahead_shift
        off = 1 / (1 + np.exp(-score)) - labels
        slope = np.bincount(columns, off[rows], n_features) / n + settings.l2 / n * ahead
        gap = 2 * share * (ahead[a] - ahead[b])
        slope = slope + np.bincount(a, gap, n_features) - np.bincount(b, gap, n_features)
        slope[-1] = 0.0
        new, new_shift = ahead - step * slope, ahead_shift - off.mean()
        if (new - w) @ (w - ahead) > 0:
            momentum = 1.0  # the last step went uphill
        turn = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_shift = new + (momentum - 1) / turn * (new - w), new_shift
        w, shift, momentum = new, new_shift, turn
    return w[:-1], shift


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The classifier for ``labels.toxic``; labels of the held-out fold are never read into it.

    Without labels of both kinds the model has a bias alone.
    """
    rows = training_rows(docs, labels, settings)
    sizes = {r.toxic > 0: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model(bias=float(np.log((n_toxic + 0.5) / (n_clean + 0.5))))
    words = _features(rows, n_toxic, n_clean, settings)
    value_set = pa.array(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                text, feature = _present(texts_of(part), value_set)
                bounds = np.searchsorted(text, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "toxic": part.column("toxic"),
                    "features": pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32))),
                })

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, features array<int>"
    # at most max_train rows of max_features small numbers
    sparse = rows.mapInArrow(trimmed(run), schema).orderBy("doc_id").select("toxic", "features").toArrow()
    lists = sparse.column("features").combine_chunks()
    lengths = np.asarray(pc.list_value_length(lists), np.int64)
    at = {w: i for i, w in enumerate(words)}
    weights, bias = solve(
        np.repeat(np.arange(len(lengths)), lengths), np.asarray(lists.flatten(), np.int64),
        (np.asarray(sparse.column("toxic")) > 0).astype(float), len(words),
        [(at[t], at.get(o, len(words)), n) for t, o, n in _swaps(rows)], settings,
    )
    return Model(words, weights.tolist(), bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text alone.

    A NULL text counts as the empty one and has the score of the bias.  Equal texts have equal scores.  A NULL ``doc_id`` counts
    as empty text for the fold.  Other columns are not read.  An empty table gives an empty result.
    """
    value_set, weights, bias = pa.array(model.words, pa.string()), np.asarray(model.weights), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                text, feature = _present(texts_of(part), value_set)
                total = np.bincount(text, weights[feature] if len(feature) else None, len(part)) + bias
                score = 1 / (1 + np.exp(-total))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": pa.array(score),
                    "predicted": pa.array((score >= 0.5).astype(np.int32)),
                })

    narrow = docs.select("doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(trimmed(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
