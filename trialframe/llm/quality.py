"""Quality by co-training: a text classifier and a metadata classifier teach each other.

The text view sees the words of the whole text (hashed, log counts) and its shape
(lengths, shares of digits, capitals, marks, repeated words and lines). The
metadata view sees source, language and size. Both are logistic regressions.
They start from the labelled documents of a bounded sample. In each round Spark
scores every unlabelled document by both views; quantiles of all scores give the
documents that a view is surest of, as good and as poor in the proportion of the
labels, and a growing share of the pool. The view labels them, and a bounded sample
of them, by id hash, trains the other view. A part of the labelled sample that is
never trained on calibrates each view and the weights with which their log odds are
combined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialframe.llm._arrays import SpanHash, byte_table, chunks, list_array, spans, text_bytes
from trialframe.llm._learning import bounded_sample, held_out, list_rows
from trialframe.session import materialize

MOST_PER_LABEL = 1500
MOST_HANDED = 750  # documents of one pseudo-label that train a view in a round
ROUNDS = 3
HANDED_OVER = 0.05  # of the pool, labelled by a view in the first round; twice as much in the second, and so on
QUANTILE_ACCURACY = 10_000
BITS = 11
META_BITS = 9
_WORD = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)
_LINE = byte_table(lambda b: b != 0x0A)
_KINDS = [byte_table(f) for f in (lambda b: 0x30 <= b <= 0x39, lambda b: 0x41 <= b <= 0x5A, lambda b: b >= 0x80, lambda b: b in b" \t\r\n", lambda b: b < 0x80 and not chr(b).isalnum() and not chr(b).isspace())]
SHAPES = 14


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def _distinct(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes in each row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[first], minlength=n)


def text_view(column: pa.Array) -> np.ndarray:
    """One row of features for each text: hashed words, then shape."""
    data, at = text_bytes(column)
    n = len(column)
    size = np.maximum(np.diff(at), 1).astype(np.float64)
    start, stop, rows = spans(data, at, _WORD)
    lower, _ = text_bytes(pc.ascii_lower(column))
    hashed = SpanHash(lower)
    words = hashed(start, stop)
    n_words = np.bincount(rows, minlength=n)
    counts = np.bincount(rows * (1 << BITS) + (words >> np.uint64(64 - BITS)).astype(np.int64), minlength=n << BITS).reshape(n, -1)
    bag = np.log1p(counts)
    bag /= np.maximum(np.sqrt((bag**2).sum(axis=1, keepdims=True)), 1e-9)
    line_start, line_stop, line_rows = spans(data, at, _LINE)
    n_lines = np.bincount(line_rows, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, (stop - start).astype(np.float64))
    shape = [_per_row(kind[data], at) / size for kind in _KINDS]
    shape += [
        np.log1p(np.diff(at)) / 10,
        np.log1p(n_words) / 10,
        np.log1p(n_lines) / 5,
        np.bincount(rows, stop - start, n) / np.maximum(n_words, 1) / 10,
        _distinct(words, rows, n) / np.maximum(n_words, 1),
        _distinct(hashed(line_start, line_stop), line_rows, n) / np.maximum(n_lines, 1),
        np.log1p(longest) / 5,
        n_words / size * 5,
        np.where(n_words > 0, 1.0, 0.0),
    ]
    return np.concatenate([bag, np.stack(shape, axis=1)], axis=1).astype(np.float32)


def meta_view(source: list, lang: list, size: np.ndarray) -> np.ndarray:
    """Hashed source, language and their pair, and the size in steps of its logarithm; nulls are values of their own."""
    out = np.zeros((len(source), 1 << META_BITS), np.float32)
    steps = np.where(np.isnan(size), -1, np.floor(2 * np.log2(1 + np.maximum(np.nan_to_num(size), 0))))
    for row, (s, l, k) in enumerate(zip(source, lang, steps)):
        for value in (f"s={s}", f"l={l}", f"k={k}", f"s={s} l={l}"):
            out[row, xxhash.xxh64_intdigest(value) >> (64 - META_BITS)] = 1
    return out


@dataclass
class View:
    weights: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale[0] * (x @ self.weights + self.bias) + self.scale[1], -20, 20)


@dataclass
class QualityModel:
    text: View
    meta: View
    mix: np.ndarray  # weight of the text view, of the metadata view, and bias

    def odds(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.odds(text), self.meta.odds(meta)
        return self.mix[0] * a + self.mix[1] * b + self.mix[2], a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 150, rate: float = 0.1) -> View:
    """Ridge logistic regression by Adam over all rows."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for k in range(1, steps + 1):
        error = (sigmoid(x @ w + b) - y) / len(y)
        g = np.append(x.T @ error.astype(np.float32) + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = (w - change[:-1]).astype(np.float32), b - change[-1]
    return View(w, float(b))


def fit_small(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a few columns and a bias, by Newton steps with a ridge towards (1/k, ..., 0)."""
    design = np.column_stack([x, np.ones(len(x))])
    prior = np.append(np.full(x.shape[1], 1 / x.shape[1]), 0.0)
    w = prior.copy()
    for _ in range(50):
        p = sigmoid(design @ w)
        g = design.T @ ((p - y) * weight) + (w - prior)
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return w


def bounds(share: float, good: float) -> tuple[float, float]:
    """Quantiles of the scores up to which documents are poor, and from which they are good."""
    return share * (1 - good), 1 - share * good


def handed_over(scored: DataFrame, share: float, good: float, most: int) -> DataFrame:
    """(id, pupil, label) of the documents that one view labels for the other, ``most`` of each pupil and label at most.

    ``scored`` has (id, text_odds, meta_odds) of the whole pool. Where a view's scores are so much
    alike that both quantiles meet, it labels nothing.
    """
    low, high = bounds(share, good)
    cut = scored.agg(*(F.percentile_approx(c, F.array(F.lit(low), F.lit(high)), F.lit(QUANTILE_ACCURACY)) for c in ("text_odds", "meta_odds"))).first()
    parts = []
    for pupil, teacher, found in (("meta", "text_odds", cut[0]), ("text", "meta_odds", cut[1])):
        if found is not None and found[0] < found[1]:
            label = F.when(F.col(teacher) >= found[1], 1).when(F.col(teacher) <= found[0], 0)
            parts.append(scored.select("id", F.lit(pupil).alias("pupil"), label.alias("label")).where("label is not null"))
    if not parts:
        return scored.select("id", F.lit("").alias("pupil"), F.lit(0).alias("label")).limit(0)
    rows = reduce(DataFrame.unionByName, parts).withColumn("kind", F.concat("pupil", F.col("label").cast("string")))
    return bounded_sample(rows, "id", "kind", most).select("id", "pupil", "label")


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, hand: Callable, rounds: int = ROUNDS) -> tuple[View, View]:
    """Both views after the rounds. ``hand(views, share)`` gives what they label: (features, labels) for the text view and for the other."""
    first = views = fit_logistic(text, label), fit_logistic(meta, label)
    for k in range(rounds):
        handed = hand(views, HANDED_OVER * (k + 1))
        if not any(len(y) for _, y in handed):
            return views
        views = tuple(
            fit_logistic(np.concatenate([own, x]), np.concatenate([label, y])) if len(y) else before
            for own, (x, y), before in zip((text, meta), handed, first)
        )
    return views


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    size_col: str = "n_chars",
    label_col: str = "quality",
    most_per_label: int = MOST_PER_LABEL,
    most_handed: int = MOST_HANDED,
) -> QualityModel:
    """Learns from at most ``most_per_label`` documents of each label, and what the views label in the pool of all others.

    All of them have an id whose crc32 leaves a rest by 5. Of several labels of
    an id the lowest holds. Without both labels every text scores the same.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.min(label_col) > 0).cast("int").alias("label"))
    )
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "id", "label", most_per_label).select("id", "label")
    every = _rows(docs, id_col, text_col, source_col, lang_col, size_col)

    def features(wanted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labels and features of the documents in ``wanted`` (id, label), in order of their ids; one row of each id."""
        rows = every.join(F.broadcast(wanted), "id").dropDuplicates(["id"])  # within the bounds of the samples

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, text, meta in _views(batch):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(5), *(list_array(np.full(len(x), x.shape[1]), pa.array(x.ravel())) for x in (text, meta))],
                        names=["id", "label", "text", "meta"],
                    )

        kind = rows.schema["id"].dataType.simpleString()
        found = rows.mapInArrow(run, f"id {kind}, label int, text array<float>, meta array<float>").toArrow().sort_by([("id", "ascending")])
        widths = (1 << BITS) + SHAPES, 1 << META_BITS
        x = [np.stack(own) if (own := list_rows(found[c])) else np.empty((0, w), np.float32) for c, w in zip(("text", "meta"), widths)]
        return found["label"].to_numpy().astype(np.int64), *x

    label, text, meta = features(chosen)
    if not {0, 1} <= set(label.tolist()):
        width = (1 << BITS) + SHAPES
        flat = 20.0 if 1 in label else -20.0 if 0 in label else 0.0
        return QualityModel(View(np.zeros(width, np.float32), 0.0), View(np.zeros(1 << META_BITS, np.float32), 0.0), np.array([0.0, 0.0, flat]))
    pool = every.where(F.col("id").isNotNull() & ~held_out("id"))

    def hand(views: tuple[View, View], share: float) -> list[tuple[np.ndarray, np.ndarray]]:
        scored = _scored(pool, QualityModel(*views, np.zeros(3)))
        scored = scored.join(known.select("id"), "id", "left_anti").groupBy("id").agg(*(F.max(c).alias(c) for c in ("text_odds", "meta_odds")))
        scored = materialize(scored)
        wanted = materialize(handed_over(scored, share, float(label.mean()), most_handed))
        out = []
        for pupil, column in (("text", 1), ("meta", 2)):
            found = features(wanted.where(F.col("pupil") == pupil).select("id", "label"))
            out.append((found[column], found[0]))
        return out

    aside = np.zeros(len(label), bool)
    for k in (0, 1):
        aside[np.flatnonzero(label == k)[3::4]] = True
    aside &= (label == 0).sum() >= 8 and (label == 1).sum() >= 8
    views = co_train(text[~aside], meta[~aside], label[~aside], hand)
    judges = np.flatnonzero(aside if aside.any() else ~aside)
    y = label[judges].astype(np.float64)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    weight *= len(y) / weight.sum()
    for view, x in zip(views, (text, meta)):
        a, b = fit_small((x[judges] @ view.weights + view.bias)[:, None], y, weight)
        view.scale = (float(max(a, 0.0)), float(b))
    mix = fit_small(np.stack([v.odds(x[judges]) for v, x in zip(views, (text, meta))], axis=1), y, weight)
    return QualityModel(*views, mix)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, size_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(size_col).cast("double").alias("size"),
    )


def _views(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part, column in chunks(batch):
        for lo in range(0, len(part), 1024):
            some, texts = part.slice(lo, 1024), column.slice(lo, 1024)
            size = some.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
            yield some, text_view(texts), meta_view(some.column(2).to_pylist(), some.column(3).to_pylist(), size)


def score_quality(
    docs: DataFrame,
    model: QualityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    size_col: str = "n_chars",
) -> DataFrame:
    """(id, score, score_text, score_meta): probability of good quality, from both views and from each.

    A null text counts as empty; null metadata are values of their own. Rows with
    equal ids each keep their row. An empty table gives an empty one.
    """
    found = _scored(_rows(docs, id_col, text_col, source_col, lang_col, size_col), model)
    p = {"score": "odds", "score_text": "text_odds", "score_meta": "meta_odds"}
    return found.select("id", *((1 / (1 + F.exp(-F.col(odds)))).alias(name) for name, odds in p.items()))


def _scored(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(id, odds, text_odds, meta_odds): log odds of every row of ``_rows``, within -30 and 30."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text, meta in _views(batch):
                found = [pa.array(np.clip(x, -30, 30).astype(np.float64)) for x in model.odds(text, meta)]
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["id", "odds", "text_odds", "meta_odds"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, odds double, text_odds double, meta_odds double")
