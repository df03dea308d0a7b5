"""Language ID: a bidirectional gated recurrent network over bytes that labels every position, pooled to documents.

A text is cut into windows of ``SPAN`` bytes with ``WARM`` more on either side, where there are, which both directions read from zero states; the labels
of the bytes outside the window, read to bring the states up to it, are left out. So the
windows of all rows of a slice go side by side through the network, one byte of each at a time, whatever the lengths. Each byte
gets a softmax over the languages from both states; a document's probabilities
are the means over all its bytes, its language the largest (ties: the first by name). The
network is trained in numpy by backpropagation through time on windows of up to ``SAMPLE`` labelled
documents of each language (by hash of the id), every position with its document's label, with Adam; a text shorter than a training window is repeated in it.

Defined cases: a null or empty text has a null language, probability and share; where no row has a label, all have; with one
language, that one has probability 1; null ids are kept; repeated rows are labelled alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text
from .store import table

HIDDEN, SPAN, WARM = 8, 128, 16
#: Documents of a language and windows of a document that training sees; its steps, windows in each, and their length.
SAMPLE, PIECES, STEPS, BATCH, LENGTH = 250, 6, 160, 384, 64


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fresh(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights of both directions: inputs x, recurrences u (update, reset), n (candidate) with bias c, and outputs v, b."""
    p = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        p[f"{d}u"] = rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN))
        p[f"{d}n"] = rng.normal(0, 0.3, (HIDDEN, HIDDEN))
        p[f"{d}c"] = np.zeros(HIDDEN)
        p[f"{d}v"] = rng.normal(0, 0.3, (HIDDEN, classes))
    p["b"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all positions of windows x (step, window) with labels y, and its gradient."""
    steps, n = x.shape
    h_, kept, logits = HIDDEN, {}, np.tile(p["b"], (steps, n, 1))
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((n, h_), np.float32)
        kept[d] = []
        for t in order:
            i = p[f"{d}x"][x[t]]
            zr = sigmoid(i[:, : 2 * h_] + h @ p[f"{d}u"])
            z, r = zr[:, :h_], zr[:, h_:]
            a = h @ p[f"{d}n"] + p[f"{d}c"]
            c = np.tanh(i[:, 2 * h_ :] + r * a)
            kept[d].append((t, h, z, r, a, c))
            h = c + z * (h - c)
            logits[t] += h @ p[f"{d}v"]
    q = np.exp(logits - logits.max(2, keepdims=True))
    q /= q.sum(2, keepdims=True)
    loss = float(-np.log(q[:, np.arange(n), y] + 1e-12).mean())
    q[:, np.arange(n), y] -= 1
    q /= steps * n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["b"] = q.sum((0, 1))
    for d in "fb":
        back = np.zeros((n, h_), np.float32)
        for t, h, z, r, a, c in reversed(kept[d]):
            now = c + z * (h - c)
            g[f"{d}v"] += now.T @ q[t]
            dh = back + q[t] @ p[f"{d}v"].T
            dc = dh * (1 - z) * (1 - c * c)
            da = dc * r
            dzr = np.concatenate([dh * (h - c) * z * (1 - z), dc * a * r * (1 - r)], axis=1)
            g[f"{d}u"] += h.T @ dzr
            g[f"{d}n"] += h.T @ da
            g[f"{d}c"] += da.sum(0)
            np.add.at(g[f"{d}x"], x[t], np.concatenate([dzr, dc], axis=1))
            back = dh * z + dzr @ p[f"{d}u"].T + da @ p[f"{d}n"].T
    return loss, g


def train(texts: pa.Array, labels: np.ndarray, classes: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights from labelled texts (labels are numbers under ``classes``); classes have equal shares of each step's windows."""
    rng = np.random.default_rng(seed)
    p = fresh(classes, rng)
    data, offs = text.raw(texts)
    size = np.diff(offs)
    by = [np.flatnonzero((labels == c) & (size > 0)) for c in range(classes)]
    able = [c for c in range(classes) if len(by[c])]
    if not able:
        return p
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for k in range(1, STEPS + 1):
        rows = np.concatenate([rng.choice(by[c], BATCH // len(able) + 1) for c in able])
        piece = rng.integers(0, PIECES, len(rows)) / max(1, PIECES - 1)
        start = (np.maximum(0, size[rows] - LENGTH) * piece).astype(np.int64)
        _, g = gradients(p, data[offs[:-1][rows] + (start + np.arange(LENGTH)[:, None]) % size[rows]], labels[rows])
        rate = 0.02 * min(1.0, 2.2 - 2 * k / STEPS)
        for w in p:
            m[w], v[w] = 0.9 * m[w] + 0.1 * g[w], 0.99 * v[w] + 0.01 * g[w] * g[w]
            p[w] -= (rate * (m[w] / (1 - 0.9**k)) / (np.sqrt(v[w] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return p


def halves(p: dict) -> dict:
    """The weights as ``pooled`` takes them: halved where a sigmoid is a tanh of half its input."""
    h = HIDDEN
    out = {"bias": p["b"]}
    for d in "fb":
        out[d] = (np.ascontiguousarray(p[f"{d}x"][:, : 2 * h] * 0.5), np.ascontiguousarray(p[f"{d}x"][:, 2 * h :]), p[f"{d}u"] * np.float32(0.5), p[f"{d}n"], p[f"{d}c"], p[f"{d}v"])
    return out


def pooled(data: np.ndarray, offs: np.ndarray, p: dict, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each row the sums over its bytes of the probabilities, and of the bytes with each label."""
    classes = len(p["bias"])
    size = np.diff(offs)
    count = -(-size // SPAN)
    row = np.repeat(np.arange(len(size)), count)
    start = offs[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SPAN
    first_out = np.minimum(WARM, start - offs[:-1][row])
    last_out = first_out + np.minimum(SPAN, offs[1:][row] - start)
    start = start - first_out
    length = np.minimum(last_out + WARM, offs[1:][row] - start)
    order = np.argsort(-length, kind="stable")
    mass, votes = np.zeros((len(row), classes), np.float32), np.zeros((len(row), classes), np.float32)
    padded = np.concatenate([data, np.zeros(SPAN + 2 * WARM, np.uint8)])
    h_ = HIDDEN
    for at in range(0, len(order), lanes):
        own = order[at : at + lanes]
        n, steps = len(own), int(length[own[0]])
        lo, hi = first_out[own], last_out[own]
        x = np.ascontiguousarray(padded[start[own] + np.arange(steps)[:, None]])
        active = np.searchsorted(-length[own], -np.arange(steps), "left")
        logits = np.empty((steps, n, classes), np.float32)
        sum_p, sum_v = np.zeros((n, classes), np.float32), np.zeros((n, classes), np.float32)
        for d, ts in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            xz, xn, u, un, c0, v = p[d]
            h = np.zeros((n, h_), np.float32)
            zr, cand, tmp = np.empty((n, 2 * h_), np.float32), np.empty((n, h_), np.float32), np.empty((n, 2 * h_), np.float32)
            for t in ts:
                k = active[t]
                hk, zk, ck, tk = h[:k], zr[:k], cand[:k], tmp[:k]
                np.take(xz, x[t, :k], axis=0, out=zk, mode="clip")
                np.matmul(hk, u, out=tk)
                zk += tk
                np.tanh(zk, out=zk)
                a = hk @ un
                a += c0
                a *= zk[:, h_:] * np.float32(0.5) + np.float32(0.5)
                np.take(xn, x[t, :k], axis=0, out=ck, mode="clip")
                ck += a
                np.tanh(ck, out=ck)
                hk -= ck
                hk *= zk[:, :h_] * np.float32(0.5) + np.float32(0.5)
                hk += ck
                if d == "f":
                    np.matmul(hk, v, out=logits[t, :k])
                else:
                    out = logits[t, :k]
                    out += hk @ v
                    out += p["bias"]
                    best = out.max(1, keepdims=True)
                    here = ((t >= lo[:k]) & (t < hi[:k]))[:, None]
                    sum_v[:k] += (out == best) & here
                    out -= best
                    np.exp(out, out=out)
                    out /= out.sum(1, keepdims=True)
                    out *= here
                    sum_p[:k] += out
        mass[own], votes[own] = sum_p, sum_v
    first = np.cumsum(count) - count
    out = np.zeros((2, len(size), classes))
    full = np.flatnonzero(count)
    if len(full):
        out[0, full] = np.add.reduceat(mass.astype(np.float64), first[full])
        out[1, full] = np.add.reduceat(votes.astype(np.float64), first[full])
    return out[0], out[1]


def model(docs: DataFrame) -> tuple[list[str], dict]:
    """Languages, and weights trained on a sample of labelled rows."""
    known = docs.where("lang is not null and doc_id is not null and length(text) > 0").select("doc_id", "lang").distinct()
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.withColumn("turn", turn).where(F.col("turn") <= SAMPLE).drop("turn")  # each task passes on SAMPLE rows of a language at most
    langs = sorted(r.lang for r in picked.select("lang").distinct().collect())
    if not langs:
        return [], {}
    rows = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(picked), ["doc_id", "lang"]).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    index = {x: k for k, x in enumerate(langs)}
    return langs, train(rows["text"].combine_chunks(), np.array([index[x] for x in rows["lang"].to_pylist()]), len(langs))


def labelled(docs: DataFrame, langs: list[str], weights: dict) -> DataFrame:
    """doc_id, language, probability, and share: of the bytes, those that have the document's language as label."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, halves(weights) if weights else None))

    def run(batches):
        names, p = shared.value
        for whole in batches:
            for b in text.slices(whole, "text", 1 << 20):
                data, offs = text.raw(b.column("text"))
                size = np.diff(offs)
                none = size == 0
                if p is None:
                    lang, prob, share = pa.nulls(len(size), pa.string()), pa.nulls(len(size), pa.float64()), pa.nulls(len(size), pa.float64())
                else:
                    mass, votes = pooled(data, offs, p)
                    best = mass.argmax(1)
                    each = np.arange(len(size))
                    lang = pa.array(np.array(names, object)[best], pa.string(), mask=none)
                    prob = pa.array(np.round(mass[each, best] / np.maximum(1, size), 6), mask=none)
                    share = pa.array(np.round(votes[each, best] / np.maximum(1, size), 6), mask=none)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lang, prob, share], ["doc_id", "language", "probability", "share"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, language string, probability double, share double")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return labelled(docs, *model(docs))
