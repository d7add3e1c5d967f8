"""Toxicity: a small convolutional text classifier, trained in numpy on a bounded sample.

A word is the sum of the embeddings of its hashed features (the word, two
prefixes, a suffix). Filters of widths 1, 2 and 3 slide over the words of the
whole text; each filter's maximum goes through a rectifier into a logistic
output. Training is AdaGrad on the documents of the sample; embeddings start from
the smoothed log odds of their features.

The score is calibrated on scores that each document of the sample gets from a
model trained without it (``FOLDS`` folds): logistic scaling, then a threshold for
each language with enough toxic documents, one for all others, and a probability
of one half where the sample is too small to choose. The language is guessed from
the text by word features (the language column only names the guesses while
learning). A score of 0.5 is the threshold. Scoring needs the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialframe.llm._arrays import SpanHash, byte_table, chunks, list_array, mixed, spans, text_bytes
from trialframe.llm._learning import bounded_sample, held_out, list_rows

MOST_PER_LABEL = 2500
BUCKETS = 1 << 15
FEATURES = 4
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS)
FOLDS = 4
LEAST_POSITIVES = 30  # toxic documents, and others, that a threshold of its own takes
_WORD = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_SALTS = np.random.default_rng(7).integers(1, 1 << 63, FEATURES, dtype=np.uint64)


@dataclass
class Model:
    embedding: np.ndarray  # FEATURES * BUCKETS x DIMENSIONS
    filters: dict[int, np.ndarray]  # by width: width x DIMENSIONS x FILTERS
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    languages: list[str] = field(default_factory=list)
    by_word: np.ndarray | None = None  # BUCKETS x languages: log probability of the word feature
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: np.ndarray | None = None  # by guess, as log odds of the scaled score


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (words x FEATURES) and the row of each word."""
    data, at = text_bytes(pc.utf8_lower(column))
    start, stop, rows = spans(data, at, _WORD)
    hashed = SpanHash(data)
    parts = (
        hashed(start, stop),
        hashed(start, np.minimum(start + 6, stop)),
        hashed(start, np.minimum(start + 8, stop)),
        hashed(np.maximum(stop - 6, start), stop),
    )
    ids = np.empty((len(start), FEATURES), np.int32)
    for k, h in enumerate(parts):
        ids[:, k] = (mixed(h ^ _SALTS[k]) >> np.uint64(49)).astype(np.int32) + k * BUCKETS
    return ids, rows


def padded(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors with PAD zero rows after each document, and the first row of each."""
    first = np.cumsum(counts + PAD) - (counts + PAD)
    out = np.zeros((len(x) + PAD * (len(counts) + 1), x.shape[1]), x.dtype)
    if len(x):
        rows = np.repeat(np.arange(len(counts)), counts)
        out[np.arange(len(x)) + PAD * rows] = x
    return out, first


def convolve(x: np.ndarray, filters: dict[int, np.ndarray]) -> np.ndarray:
    """Filter values at every row of padded word vectors."""
    out = []
    for width, weights in filters.items():
        total = x @ weights[0]
        for k in range(1, width):
            shifted = x[k:] @ weights[k]
            total[: len(shifted)] += shifted
        out.append(total)
    return np.concatenate(out, axis=1)


def embed(embedding: np.ndarray, ids: np.ndarray) -> np.ndarray:
    x = embedding[ids[:, 0]]
    for k in range(1, FEATURES):
        x += embedding[ids[:, k]]
    return x


def raw_scores(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x, first = padded(embed(model.embedding, ids), counts)
    ends = np.stack([first, first + counts + 1], axis=1).ravel()
    best = np.maximum.reduceat(convolve(x, model.filters), ends, axis=0)[::2] if len(counts) else np.empty((0, len(model.out)))
    return np.maximum(best + model.bias, 0) @ model.out + model.out_bias


def guesses(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Language guess of each document, by place in ``model.languages``; the last place is no guess."""
    if not len(model.languages) or not len(counts):
        return np.full(len(counts), len(model.languages))
    at = np.cumsum(counts) - counts
    sums = np.add.reduceat(np.concatenate([model.by_word[ids[:, 0]], np.zeros((1, model.by_word.shape[1]), np.float32)]), at, axis=0)
    return np.where(counts > 0, sums.argmax(axis=1), len(model.languages))


def scores(model: Model, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    a, b = model.scale
    odds = a * raw_scores(model, ids, counts) + b - model.threshold[guesses(model, ids, counts)]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(ids: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.1, seed: int = 1) -> Model:
    """Fits the network; ``ids`` are the word features of each document."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    seen = [np.zeros(FEATURES * BUCKETS), np.zeros(FEATURES * BUCKETS)]
    for own, label in zip(ids, labels):
        seen[int(label)][np.unique(own)] += 1
    n = [max((labels == k).sum(), 1) for k in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    embedding = rng.normal(0, 0.05, (FEATURES * BUCKETS, DIMENSIONS)).astype(np.float32)
    embedding[:, 0] = 0.25 * np.clip(odds, -2, 3) * np.minimum(1, (seen[0] + seen[1]) / 5)
    embedding[seen[0] + seen[1] == 0] = 0  # features the sample lacks say nothing
    filters = {w: rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
    for weights in filters.values():
        weights[:, 0] = np.abs(weights[:, 0]) + 0.3
    model = Model(embedding, filters, np.full(n_filters, 0.1, np.float32), np.full(n_filters, 0.3, np.float32), -1.0)
    sums = {"embedding": np.full(embedding.shape, 1e-3, np.float32), "bias": np.full(n_filters, 1e-3), "out": np.full(n_filters, 1e-3), "out_bias": 1e-3}
    sums |= {w: np.full(filters[w].shape, 1e-3, np.float32) for w in WIDTHS}
    weight = np.where(labels == 1, len(labels) / (2 * n[1]), len(labels) / (2 * n[0]))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            _step(model, sums, [ids[r] for r in rows], labels[rows], weight[rows], rate)
    return model


def _step(model: Model, sums: dict, ids: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
    counts = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    x, first = padded(embed(model.embedding, flat), counts)
    z = convolve(x, model.filters)
    at = np.stack([f + z[f : f + c + 1].argmax(axis=0) for f, c in zip(first, counts)])
    best = z[at, np.arange(z.shape[1])]
    hidden = np.maximum(best + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
    error = (p - labels) * weight / len(labels)
    back = error[:, None] * model.out * (hidden > 0)
    changes = {"out": error @ hidden, "out_bias": error.sum(), "bias": back.sum(axis=0)}
    padded_ids = np.full((len(x), FEATURES), -1, np.int64)
    padded_ids[np.arange(len(flat)) + PAD * np.repeat(np.arange(len(counts)), counts)] = flat
    touched, grads = [], []
    for k, width in enumerate(WIDTHS):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        place, g = at[:, own], back[:, own]
        change = np.zeros_like(model.filters[width])
        for j in range(width):
            change[j] = np.einsum("bfd,bf->df", x[place + j], g)
            touched.append(padded_ids[place + j].reshape(-1, FEATURES))
            grads.append((g[:, :, None] * model.filters[width][j].T[None]).reshape(-1, DIMENSIONS))
        sums[width] += change**2
        model.filters[width] -= (rate * change / np.sqrt(sums[width])).astype(np.float32)
    for name, change in changes.items():
        sums[name] = sums[name] + change**2
        setattr(model, name, getattr(model, name) - rate * change / np.sqrt(sums[name]))
    which, grad = np.concatenate(touched), np.concatenate(grads)
    real = (which[:, 0] >= 0) & np.any(grad != 0, axis=1)
    rows, inverse = np.unique(which[real].ravel(), return_inverse=True)
    total = np.zeros((len(rows), DIMENSIONS), np.float32)
    np.add.at(total, inverse, np.repeat(grad[real], FEATURES, axis=0))
    sums["embedding"][rows] += total**2
    model.embedding[rows] -= rate * 0.5 * total / np.sqrt(sums["embedding"][rows])


def calibrate(model: Model, raw: np.ndarray, guess: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
    """Logistic scaling of ``raw`` scores, then thresholds of the best F1; ``weight``: rows a row stands for."""
    model.threshold = np.zeros(len(model.languages) + 1)
    weight = weight * len(weight) / weight.sum()
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((p - labels) * weight * raw).sum() + (a - 1), ((p - labels) * weight).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 1, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    if a <= 0:  # no better than chance: every score at the share of toxic documents
        share = float((labels * weight).sum() / weight.sum())
        a, b = 0.0, float(np.log(share / (1 - share)))
    model.scale = (float(a), float(b))
    odds = a * raw + b

    def enough(own: np.ndarray) -> bool:
        return min(labels[own].sum(), (1 - labels[own]).sum()) >= LEAST_POSITIVES

    if enough(np.ones(len(raw), bool)):
        model.threshold[:] = best_threshold(odds, labels, weight)
    for k, lang in enumerate(model.languages):
        if lang is not None and enough(own := guess == k):
            model.threshold[k] = best_threshold(odds[own], labels[own], weight[own])


def best_threshold(odds: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-odds)
    hit, all_ = np.cumsum((labels * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (labels * weight).sum())
    k = int(f1.argmax())
    low = odds[order[k + 1]] if k + 1 < len(order) else odds[order[k]] - 1
    return float((odds[order[k]] + low) / 2)


def learn_languages(model: Model, ids: list[np.ndarray], langs: list, label: np.ndarray) -> None:
    """Log probabilities of the word feature by language, for the guess that picks a threshold.

    A language has a column of its own if ``LEAST_POSITIVES`` rows of either label are in it,
    so the bound of the sample bounds their number. All others share the column None, whose
    threshold is the shared one.
    """
    rows = {lang: np.flatnonzero([x == lang for x in langs]) for lang in {x for x in langs if x is not None}}
    often = {lang for lang, own in rows.items() if min(label[own].sum(), (1 - label[own]).sum()) >= LEAST_POSITIVES}
    names = sorted(often, key=lambda x: (-len(rows[x]), x)) + [None] * (len(rows) > len(often))
    table = np.full((BUCKETS, len(names)), 0.1)
    for lang, own in rows.items():
        column = names.index(lang if lang in often else None)
        for k in own:
            np.add.at(table[:, column], ids[k][:, 0], 1)
    model.languages = names
    model.by_word = np.log(table / table.sum(axis=0)).astype(np.float32) if names else np.zeros((BUCKETS, 1), np.float32)


def train_folds(spark: SparkSession, ids: list[np.ndarray], label: np.ndarray) -> tuple[Model, np.ndarray]:
    """The model of all rows, and the raw score of each row by a model of the other folds; each training is a task."""
    fold = np.zeros(len(ids), np.int64)
    for k in (0, 1):  # both labels in every fold
        fold[label == k] = np.arange((label == k).sum()) % FOLDS
    shared = spark.sparkContext.broadcast((ids, label, fold))  # the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, fold = shared.value
        counts = np.array([len(x) for x in ids])
        for batch in batches:
            for k in batch.column(0).to_pylist():  # FOLDS stands for all rows
                own = train([x for x, f in zip(ids, fold) if f != k], label[fold != k])
                out, raw = np.flatnonzero(fold == k), np.empty(0)
                if len(out):
                    some = np.array_split(out, 1 + len(out) // 128)
                    raw = np.concatenate([raw_scores(own, np.concatenate([ids[r] for r in rows]), counts[rows]) for rows in some])
                found = pickle.dumps((own if k == FOLDS else None, raw))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found], pa.binary())], names=["fold", "found"])

    rows = spark.range(0, FOLDS + 1, 1, FOLDS + 1).mapInArrow(run, "fold bigint, found binary").collect()
    raw, model = np.zeros(len(ids)), None
    for k, found in rows:
        own, scored = pickle.loads(bytes(found))
        raw[fold == k] = scored
        model = own if k == FOLDS else model
    shared.unpersist()
    return model, raw


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    most_per_label: int = MOST_PER_LABEL,
) -> Model:
    """Learns from at most ``most_per_label`` documents of each label whose id's crc32 leaves a rest by 5.

    Label rows without id or label are left out; of several labels of an id the
    larger holds. Without documents of both labels the model scores every text
    the same: 0, or 1 where all are toxic.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "id", "label", most_per_label)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.join(F.broadcast(chosen), "id").select("id", "text", "lang", "label")  # at most two times the bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                ids, of = word_features(column)
                counts = np.bincount(of, minlength=len(part)) * FEATURES
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), list_array(counts, pa.array(ids.ravel())), part.column(2), part.column(3)], names=["id", "words", "lang", "label"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, words array<int>, lang string, label int").toArrow()
    found = found.sort_by([("id", "ascending")])
    ids = [x.reshape(-1, FEATURES) for x in list_rows(found["words"])]
    langs, label = found["lang"].to_pylist(), found["label"].to_numpy().astype(np.int64)
    if len(set(label.tolist())) < 2:
        model = train([], np.empty(0, np.int64), epochs=0)
        model.out[:], model.out_bias = 0, 30.0 if len(label) and label[0] else -30.0
        learn_languages(model, [], [], label[:0])
        model.threshold = np.zeros(1)
        return model
    weight = np.where(label == 1, totals[1] / (label == 1).sum(), totals[0] / (label == 0).sum())
    model, raw = train_folds(docs.sparkSession, ids, label)
    learn_languages(model, ids, langs, label)
    counts = np.array([len(x) for x in ids])
    parts = np.array_split(np.arange(len(ids)), 1 + len(ids) // 128)
    guess = np.concatenate([guesses(model, np.concatenate([ids[r] for r in some]), counts[some]) for some in parts])
    calibrate(model, raw, guess, label, weight)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): score from 0 to 1 of every whole text; 0.5 or more means toxic.

    A null text counts as empty and gets the score of an empty text. Rows with
    equal ids each keep their row. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                ids, of = word_features(column)
                found = scores(model, ids, np.bincount(of, minlength=len(part)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
