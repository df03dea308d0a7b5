"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities and fixed thresholds.

Three families of hashed features, each as shares of a text's items: words in lower case,
pairs of neighbouring words (a word next to itself is one feature of its own, whatever the
word), and byte 3-grams with their case. A logistic regression is fitted on a bounded
sample of labelled rows (``SAMPLE`` per class, near copies once), its probability calibrated on margins
that each row gets from the other folds' weights. Whole texts are scored in Arrow batches; a probability of at least ``KEEP``
keeps a document, one under ``REJECT`` rejects it, others are for review.

Defined cases: a null or empty text is rejected with probability 0; where a class has no
labels every text with words is kept with probability 1; repeated rows are scored alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, text, toxicity
from .store import table

BITS, GRAM, SCALE = 18, 3, 40.0
SAMPLE, FOLDS = 1600, 4
KEEP, REJECT = 0.5, 0.2


def families(data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and row offsets of words, word pairs and byte n-grams."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, woffs = text.words(low, offs)
    h = text.word_hashes(low, starts, ends)
    size = np.maximum(0, np.diff(woffs) - 1)
    poffs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(poffs[-1]) + np.repeat(woffs[:-1] - poffs[:-1], size)
    pair = text.mix(h[at] * text.U(0x9E3779B97F4A7C15) + h[at + 1])
    pair[h[at] == h[at + 1]] = text.U(7)
    s, inv = text.sums(data)
    m = max(0, len(data) - GRAM + 1)
    g = text.mix((s[GRAM : GRAM + m] - s[:m]) * inv[:m])
    to = text.U(64 - BITS)
    out = [((x >> to).astype(np.int64), o) for x, o in ((h, woffs), (pair, poffs), (g, None))]
    size = np.maximum(0, np.diff(offs) - GRAM + 1)
    goffs = np.concatenate([[0], np.cumsum(size)])
    out[2] = out[2][0], goffs
    return out


def margin(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(offs) - 1, bias)
    for k, (h, o) in enumerate(families(data, offs)):
        total = np.concatenate([[0], np.cumsum(weight[k][h], dtype=np.float64)])
        if k == 2:
            start, end = np.minimum(offs[:-1], len(total) - 1), np.minimum(offs[:-1] + np.diff(o), len(total) - 1)
        else:
            start, end = o[:-1], o[1:]
        z += (total[end] - total[start]) * SCALE / np.maximum(1, np.diff(o))
    return z


def train(texts: pa.Array, y: np.ndarray) -> tuple | None:
    """Weights by family, bias, calibration slope and shift; None where a class is missing.

    All rows fit the weights; they are calibrated, at the rows' own share of classes, on each row's margin by weights that the other folds fit.
    """
    keep = toxicity.unlike(texts)
    texts, y = texts.filter(pa.array(keep)), y[keep]
    fold = np.arange(len(y)) % FOLDS
    if any(not (y[fold != k] == c).any() for k in range(FOLDS) for c in (0, 1)):
        return None
    z = np.zeros(len(y))
    for k in range(FOLDS):
        held = fold == k
        if held.any():
            fitted = train_weights(texts.filter(pa.array(~held)), y[~held])
            data, offs = text.raw(texts.filter(pa.array(held)))
            z[held] = np.concatenate([margin(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], *fitted) for i, j in toxicity.ranges(offs)])
    slope, shift = linear.calibrate(z, y.astype(float))
    return *train_weights(texts, y), slope, shift


def train_weights(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by family and bias, from texts of both classes."""
    data, offs = text.raw(texts)
    index, value, sizes = [], [], []
    for i, j in toxicity.ranges(offs):
        own_offs = offs[i : j + 1] - offs[i]
        parts = []
        for k, (h, o) in enumerate(families(data[offs[i] : offs[j]], own_offs)):
            size = np.diff(o)
            own = np.repeat(np.arange(j - i), size)
            if k == 2:
                h = h[np.arange(o[-1]) + np.repeat(own_offs[:-1] - o[:-1], size)]
            pair, n = np.unique((own << BITS) | h, return_counts=True)
            own = pair >> BITS
            parts.append(((pair & ((1 << BITS) - 1)) + (k << BITS), n * SCALE / size[own], own))
        at, n, own = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(own, kind="stable")
        index.append(at[order].astype(np.int32))
        value.append(n[order])
        sizes.append(np.bincount(own, minlength=j - i))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    index, value = np.concatenate(index), np.concatenate(value)
    t = y.astype(float)
    share = np.where(t > 0, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    w, b = linear.fit(index, value, ends, t, 3 << BITS, 1e-5, rounds=60, rate=0.05, weight=share)
    return w.reshape(3, -1).astype(np.float32), b


def probability(data: np.ndarray, offs: np.ndarray, fitted: tuple | None) -> np.ndarray:
    if fitted is None:
        return (np.diff(text.words(data, offs)[2]) > 0).astype(float)
    weight, bias, slope, shift = fitted
    p = linear.sigmoid(slope * margin(data, offs, weight, bias) + shift)
    p[np.diff(offs) == 0] = 0
    return p


def scored(docs: DataFrame, fitted: tuple | None) -> DataFrame:
    """doc_id, quality (probability) and decision (keep, review, reject) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        fit = shared.value
        for whole in batches:
            for b in text.slices(whole, "text"):
                p = np.round(probability(*text.raw(b.column("text")), fit), 6)
                rule = np.where(p >= KEEP, "keep", np.where(p >= REJECT, "review", "reject"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(rule, pa.string())], ["doc_id", "quality", "decision"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality double, decision string")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.sample(docs, table(spark, sf_dir, "labels"), "quality", SAMPLE)
    return scored(docs, train(rows["text"].combine_chunks(), rows["y"].to_numpy()))
