"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased; ASCII characters that are no letters count as spaces. The
n-grams of one to three characters are hashed into buckets. A feature is the
share of a bucket among the text's n-grams times its inverse document frequency,
which is counted over every document that may be learned from. The weights are
fitted by follow-the-regularised-leader with elastic-net penalties, which leaves
most of them zero, on a bounded sample; a temperature fitted on a part of the
sample kept aside calibrates the probabilities.

As the features are shares, a text's log odds are a mean over its n-grams, and
scoring is one look-up for each n-gram of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trialframe.llm._arrays import chunks, list_array, mixed
from trialframe.llm._learning import bounded_sample, held_out, list_rows

MOST_PER_LANGUAGE = 1500
BITS = 15
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
STRENGTH = 30.0  # of the features: shares times this
UNDETERMINED = "und"
_FACTORS = np.random.default_rng(11).integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TO_SPACE = np.array([c if chr(c).isalpha() else 0x20 for c in range(128)], np.uint32)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: weight times inverse document frequency
    bias: np.ndarray
    temperature: float


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each between spaces, with its start and end."""
    points = np.frombuffer("".join(f" {t}  " for t in texts).encode("utf-32-le", "replace"), np.uint32).copy()
    low = points < 128
    points[low] = _TO_SPACE[points[low]]
    size = np.array([len(t) + 3 for t in texts], np.int64)
    end = np.cumsum(size)
    return points, end - size, end


def buckets(points: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character."""
    n = len(points) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h += points[k : k + n].astype(np.uint64) * _FACTORS[k]
    return (mixed(h) >> np.uint64(64 - BITS)).astype(np.int32)


BLANK = np.array([buckets(np.full(n, 0x20, np.uint32), n)[0] for n in SIZES])


def lowered(column: pa.Array) -> list[str]:
    return pc.utf8_lower(column).to_pylist()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` (one column) each bucket occurs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for _, column in chunks(batch, 0):
                texts = lowered(column)
                points, start, end = characters(texts)
                found = [buckets(points, size) for size in SIZES]
                flag = np.zeros(BUCKETS, bool)
                for a, b in zip(start.tolist(), end.tolist()):
                    flag[:] = False
                    for size, own in zip(SIZES, found):
                        flag[own[a : b - size + 1]] = True
                    total[:-1] += flag
                total[-1] += len(texts)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    sums = docs.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in sums.collect():  # at most the number of buckets
        out[bucket] = n
    return out[:-1], int(out[-1])


def shares(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their share of its n-grams."""
    for text in texts:
        points, _, end = characters([text])
        own = np.concatenate([buckets(points, size)[: int(end[0]) - size + 1] for size in SIZES])
        which, n = np.unique(own, return_counts=True)
        kept = ~np.isin(which, BLANK)
        yield which[kept].astype(np.int32), (n[kept] / len(own)).astype(np.float32)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    classes: np.ndarray,
    n_classes: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
    epochs: int = 3,
    seed: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x classes) and bias by follow-the-regularised-leader, one document at a time."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(z[at], n[at], l1)
            w[-1] = weights(z[-1], n[-1], 0.0)
            odds = x @ w
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[classes[k]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z[:-1], n[:-1], l1), weights(z[-1], n[-1], 0.0)


def fit_temperature(odds: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over 1/20 to 20."""

    def loss(log_t: float) -> float:
        scaled = odds / np.exp(log_t)
        top = scaled.max(axis=1)
        return float((np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top - scaled[np.arange(len(classes)), classes]).mean())

    lo, hi, step = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - step * (hi - lo), lo + step * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = MOST_PER_LANGUAGE
) -> LanguageModel:
    """Learns from documents with text and language whose id's crc32 leaves a rest by 5.

    Document frequencies cover all of them; the weights at most
    ``most_per_language`` of each language. Without any the model knows no
    language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").where(~held_out("id"))
    frequency, n = document_frequencies(rows.select("text"))
    chosen = bounded_sample(rows.select("id", "lang"), "id", "lang", most_per_language).select("id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                found = list(shares(lowered(column)))
                counts = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)]
                    + [list_array(counts, pa.array(np.concatenate(x))) for x in zip(*found)]
                    + [part.column(2)],
                    names=["id", "bucket", "share", "lang"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.join(F.broadcast(chosen), "id").select("id", "text", "lang")  # ids within the bound
    found = sample.mapInArrow(run, f"id {kind}, bucket array<int>, share array<float>, lang string").toArrow()
    found = found.sort_by([("id", "ascending"), ("lang", "ascending")])
    langs = found["lang"].to_pylist()
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    features = [(b, STRENGTH * s * idf[b]) for b, s in zip(list_rows(found["bucket"]), list_rows(found["share"]))]
    classes = np.array([languages.index(x) for x in langs])
    aside = np.arange(len(classes)) % 5 == 4
    if not aside.any() or set(classes[~aside]) != set(classes):
        aside[:] = False
    weights, bias = fit_ftrl([x for x, a in zip(features, aside) if not a], classes[~aside], len(languages))
    judges = np.flatnonzero(aside if aside.any() else ~aside)
    odds = np.array([features[k][1] @ weights[features[k][0]] + bias for k in judges])
    temperature = fit_temperature(odds, classes[judges])
    table = (STRENGTH * idf[:, None] * weights).astype(np.float32)
    table[BLANK] = 0
    return LanguageModel(languages, table, bias, temperature)


def log_odds(model: LanguageModel, texts: list[str]) -> np.ndarray:
    points, start, end = characters(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for size in SIZES:
        own = model.table[buckets(points, size)]
        ends = np.stack([start, np.minimum(end - size + 1, len(own) - 1)], axis=1).ravel()
        sums = np.add.reduceat(own, ends, axis=0)[::2]
        if end[-1] - size + 1 > len(own) - 1:  # reduceat takes no index beyond the last
            sums[-1] = own[start[-1] :].sum(axis=0)
        total += sums
    n = sum(end - start - size + 1 for size in SIZES)
    return total / n[:, None] + model.bias


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the most probable language of every whole text and its probability.

    ``und`` with score 0 if the text is null or has no letter, or if the model
    knows no language. Rows with equal ids each keep their row. An empty table
    gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, column in chunks(batch):
                texts = lowered(column)
                known = np.array([bool(model.languages) and any(map(str.isalpha, t)) for t in texts])
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
                if known.any():
                    odds = log_odds(model, texts) / model.temperature
                    p = np.exp(odds - odds.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best, score = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
                names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
