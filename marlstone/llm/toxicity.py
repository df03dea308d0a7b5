"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

Features are byte n-grams (3, 5, 7 and 9, lower case, across word ends) hashed to a fixed table, counted in
overlapping windows of a text. Each feature is scaled by its log-count ratio between
toxic and other labelled documents, with smoothed document counts; a logistic
regression is then fitted on windows: of a toxic document its most suspicious one, of
others that one and some spread over the text. A document's probability is a logistic
function, fitted on held-out labelled rows, of its three worst windows apart from each
other and of its length, so length doesn't dilute toxicity, and each whole text is read. Training takes a bounded sample of labelled rows (``SAMPLE`` per class, by hash of
the id); near copies in it count once.

Defined cases: a null or empty text has probability 0 and is not toxic; repeated rows are
scored alike; an empty table gives no rows; where labels lack a class nothing is toxic;
of windows with equal margins all count as the worst one; texts of any length are read whole; other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linear, text
from .store import table

BITS, ORDERS = 20, (3, 5, 7, 9)
#: Bytes of a window, and from one to the next.
WINDOW, STEP = 192, 96
#: Labelled documents of each class that training sees at most; windows of a clean one; documents with a feature at least.
SAMPLE, CLEAN_WINDOWS, LEAST = 1600, 6, 4
#: Jaccard similarity of word pairs from which a labelled row is a near copy of an earlier one.
COPY = 0.7
_MINS = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Standard errors that are taken off a log-count ratio.
SURE = 2.25
#: Probability from which a document is toxic.
THRESHOLD = 0.5


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order, starting at each byte as far as they fit in the buffer."""
    s, inv = text.sums(data)
    for n in ORDERS:
        m = max(0, len(data) - n + 1)
        h = (s[n : n + m] - s[:m]) * inv[:m]
        yield (text.mix(h) >> text.U(64 - BITS)).astype(np.int32)


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of all windows; the last one of a row may be shorter; an empty row has one."""
    size = np.diff(offs)
    count = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offs[:-1][row] + k * STEP
    return row, start, np.minimum(start + WINDOW, offs[1:][row])


def margins(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and margin of each window."""
    row, start, end = windows(offs)
    z = np.full(len(row), bias)
    for n, h in zip(ORDERS, grams(data), strict=True):
        total = np.concatenate([[0], np.cumsum(weight[h], dtype=np.float64)])
        z += np.where(end - start >= n, total[np.clip(end - n + 1, 0, len(total) - 1)] - total[np.minimum(start, len(total) - 1)], 0)
    return row, z


def evidence(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """For each row: the margins of its three worst windows that don't overlap a worse one, and the logarithm of its windows."""
    row, z = margins(data, offs, weight, bias)
    n = len(offs) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    out = np.empty((n, 4))
    for k in range(3):
        best = np.maximum.reduceat(z, first[:-1]) if n else np.zeros(0)
        out[:, k] = np.clip(best, -6, 12)
        hit = np.flatnonzero(z == best[row])
        for near in (hit - 1, hit, hit + 1):
            ok = (near >= 0) & (near < len(z))
            ok[ok] = row[near[ok]] == row[hit[ok]]
            z[near[ok]] = -50
    out[:, 3] = np.log1p(np.diff(first))
    return out


def probability(data: np.ndarray, offs: np.ndarray, fitted: tuple) -> np.ndarray:
    """Of each row; 0 for an empty one."""
    weight, bias, top, shift = fitted
    p = linear.sigmoid(evidence(data, offs, weight, bias) @ top + shift)
    p[np.diff(offs) == 0] = 0
    return p


def ranges(offs: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Rows from i to j, of about ``most`` bytes together, so that training needs little memory beside its tables."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j
        i = j


def pair_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's word pairs."""
    for i, j in ranges(offs):
        part = data[offs[i] : offs[j]]
        starts, ends, woffs = text.words(part, offs[i : j + 1] - offs[i])
        h, so = text.shingles(text.word_hashes(part, starts, ends), woffs, 2)
        for a, b in zip(so[:-1], so[1:], strict=True):
            yield np.unique(h[a:b])


def unlike(texts: pa.Array) -> np.ndarray:
    """False for near copies: rows whose word pairs have a Jaccard similarity of ``COPY`` at least with those of an earlier row that is kept.

    Kept rows of which a quarter of the min-hashes are equal are candidates (of copies practically all); they are verified exactly.
    """
    data, offs = text.raw(texts, lower=True)
    keep = np.ones(len(offs) - 1, bool)
    signs, kept, n = np.zeros((len(keep), len(_MINS)), np.uint64), [], 0
    for i, own in enumerate(pair_sets(data, offs)):
        if not len(own):
            continue
        sign = np.array([(own * c).min() for c in _MINS])
        for k in np.flatnonzero((signs[:n] == sign).sum(1) >= len(_MINS) // 4):
            both = len(np.intersect1d(own, kept[k], assume_unique=True))
            if both >= COPY * (len(own) + len(kept[k]) - both):
                keep[i] = False
                break
        if keep[i]:
            signs[n] = sign
            kept.append(own)
            n += 1
    return keep


def train(texts: pa.Array, y: np.ndarray) -> tuple:
    """Window weights (ratio times coefficient), bias, and the weights and shift of the evidence of a document.

    Of the labelled texts two in three fit the windows' model, the third fits how their
    evidence adds up. Without both classes, nothing is toxic.
    """
    keep = unlike(texts)
    texts, y = texts.filter(pa.array(keep)), y[keep]
    none = np.zeros(1 << BITS, np.float32), -50.0, np.zeros(4), -50.0
    held = np.arange(len(y)) % 3 == 0
    if any(not (y[part] == c).any() for part in (held, ~held) for c in (0, 1)):
        return none
    weight, bias = train_windows(texts.filter(pa.array(~held)), y[~held])
    data, offs = text.raw(texts.filter(pa.array(held)), lower=True)
    x = np.concatenate([evidence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], weight, bias) for i, j in ranges(offs)])
    t = y[held].astype(float)
    n, width = x.shape
    share = np.where(t > 0, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    centre, scale = x.mean(0), x.std(0) + 1e-6
    w, b = linear.fit(np.tile(np.arange(width), n), ((x - centre) / scale).ravel(), np.arange(0, n * width + 1, width), t, width, 1e-3, rounds=300, rate=0.1, weight=share)
    return weight, bias, w / scale, b - float((w * centre / scale).sum())


def train_windows(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Table of weights and bias, from texts of both classes."""
    dim = 1 << BITS
    data, offs = text.raw(texts, lower=True)
    df = np.zeros((2, dim), np.int32)
    for i, j in ranges(offs):
        part, row_of = data[offs[i] : offs[j]], text.owners(offs[i : j + 1])
        for n, h in zip(ORDERS, grams(part), strict=True):
            row = row_of[: len(h)]
            inside = row_of[n - 1 :] == row
            pair = np.unique((row[inside] << BITS) | h[inside])
            label = y[i + (pair >> BITS)]
            for c in (0, 1):
                np.add.at(df[c], pair[label == c] & (dim - 1), 1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    ratio = np.log((df[1] + 1) / (n1 + 2)) - np.log((df[0] + 1) / (n0 + 2))
    error = np.sqrt(1 / (df[1] + 1) + 1 / (df[0] + 1))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - SURE * error)  # what chance may have made doesn't count
    ratio[df.sum(0) < LEAST] = 0
    suspicious = np.maximum(ratio, 0).astype(np.float32)
    index, owner, target = [], [], []
    for i, j in ranges(offs):
        part, o, own_y = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], y[i:j]
        row, start, end = windows(o)
        _, z = margins(part, o, suspicious, 0.0)
        top = np.lexsort((start, -z, row))
        top = top[np.unique(row[top], return_index=True)[1]]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        every = np.maximum(1, np.bincount(row)[row] // CLEAN_WINDOWS)
        picked = np.unique(np.concatenate([top, np.flatnonzero((own_y[row] == 0) & (turn % every == 0))]))
        for n, h in zip(ORDERS, grams(part), strict=True):
            size = np.maximum(0, end[picked] - start[picked] - n + 1)
            own = np.repeat(np.arange(len(picked)), size)
            at = h[start[picked][own] + np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)]
            used = ratio[at] != 0
            index.append(at[used])
            owner.append((own[used] + len(target)).astype(np.int32))
        target.extend(own_y[row[picked]].astype(float))
    owner, target = np.concatenate(owner), np.array(target)
    order = np.argsort(owner, kind="stable").astype(np.int32)
    owner = owner[order]
    index = np.concatenate(index)[order]
    del order, df, error, suspicious
    share = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
    w, b = linear.fit(index, ratio.astype(np.float32)[index], np.searchsorted(owner, np.arange(len(target) + 1)), target, dim, 1e-4, rounds=60, rate=0.02, weight=share)
    return (w * ratio).astype(np.float32), b


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> pa.Table:
    """Up to ``most`` labelled documents of each class, by hash of the id, with their texts; training only."""
    labels = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").distinct()
    picked = None
    for c in (0, 1):
        part = labels.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").toArrow()
    return found.sort_by([("doc_id", "ascending"), ("text", "ascending"), ("y", "ascending")])


def model(docs: DataFrame, labels: DataFrame) -> tuple:
    rows = sample(docs, labels, "toxic", SAMPLE)
    return train(rows["text"].combine_chunks(), rows["y"].to_numpy())


def scored(docs: DataFrame, fitted: tuple) -> DataFrame:
    """doc_id and text's toxicity (from its three worst windows) for every row, in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        fit = shared.value
        for whole in batches:
            for b in text.slices(whole, "text"):
                data, offs = text.raw(b.column("text"), lower=True)
                p = probability(data, offs, fit)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], ["doc_id", "toxicity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, toxicity double")


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are toxic, with their probability."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scored(docs, model(docs, table(spark, sf_dir, "labels")))
    return found.where(F.col("toxicity") >= THRESHOLD).select("doc_id", F.round("toxicity", 6).alias("toxicity"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, with all their columns; the decision is made in one pass over the rows."""
    fitted = model(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(fitted)
    schema = docs.schema

    def run(batches):
        fit = shared.value
        for whole in batches:
            for b in text.slices(whole, "text"):
                data, offs = text.raw(b.column("text"), lower=True)
                p = probability(data, offs, fit)
                yield b.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, schema)
