"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are sets of ``N``-word shingles. They are partitioned by size into classes
c = 8, 16, 32, ... (c/2 < size <= c). For each class the documents' shingles are seen through windows of
2c shingles, c apart, so that a passage of an item's length always lies inside one window,
however long the document is; its Jaccard similarity with the item then has a lower bound that
depends on the containment alone, and ``HASHES`` single-value bands find it (at a containment of
``THRESHOLD`` with a miss rate under 0.5 %, at full containment under 1e-6). Window minima of a class are
minima over those of the class below, so that each shingle is hashed once per band. Each
candidate (document, item) is verified on the spot: the share of the item's distinct
shingles that the whole document has, exactly, must reach ``THRESHOLD``.

The items are broadcast in slices of at most ``SLICE``; more items mean more passes over
the documents. Documents are not shuffled.

Defined cases: null ids are dropped; a null or empty text has no shingles and matches
nothing; an item of ``SHORTEST`` to N - 1 words is one shingle of all its words, sought among the documents' runs of as many words
(containment 1); a shorter one is no evidence and never reported; ties can't occur; texts of any length are searched whole;
repeated rows count once, empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text
from .store import table

N, SHORTEST, THRESHOLD = 5, 3, 0.5
HASHES, SMALLEST = 48, 8
SLICE = 50_000
_A = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64) * text.U(2) + text.U(1)


def shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and offsets of each row; rows of fewer than N words have none."""
    data, offs = text.raw(texts, lower=True)
    starts, ends, woffs = text.words(data, offs)
    h, so = text.shingles(text.word_hashes(data, starts, ends), woffs, N)
    few = np.diff(woffs) < N
    if few.any():
        h = h[~few[text.owners(so)]]
        so = np.concatenate([[0], np.cumsum(np.where(few, 0, np.diff(so)))])
    return h, so


def runs(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, and their rows."""
    data, offs = text.raw(texts, lower=True)
    starts, ends, woffs = text.words(data, offs)
    h, so = text.shingles(text.word_hashes(data, starts, ends), woffs, k)
    row = text.owners(so)
    on = (np.diff(woffs) >= k)[row]
    return h[on], row[on]


class Index:
    """Items by size class: their minima per band, a bit table before them, and their shingles."""

    def __init__(self, item_ids: np.ndarray, texts: pa.Array):
        self.ids = item_ids
        self.h, self.offs = text.distinct(*shingled(texts))
        n_words = np.diff(text.words(*text.raw(texts, lower=True))[2])
        self.short = {}
        for k in range(SHORTEST, N):
            own = np.flatnonzero(n_words == k)
            if len(own):
                h, row = runs(texts.take(pa.array(own)), k)
                order = np.argsort(h, kind="stable")
                self.short[k] = h[order], own[row[order]]
        size = np.diff(self.offs)
        kind = np.maximum(SMALLEST, 1 << np.ceil(np.log2(np.maximum(1, size))).astype(np.int64))
        self.classes = {}
        self.bits = text.U(int(np.clip(np.ceil(np.log2(len(size) + 1)) + 8, 12, 22)))
        for c in np.unique(kind[size > 0]):
            own = np.flatnonzero((kind == c) & (size > 0))
            bands = []
            for a in _A:
                low = np.minimum.reduceat(text.mix(self.h * a), self.offs[:-1][size > 0])
                low = low[np.searchsorted(np.flatnonzero(size > 0), own)]
                order = np.argsort(low)
                seen = np.zeros(1 << int(self.bits), bool)
                seen[low & ((text.U(1) << self.bits) - text.U(1))] = True
                bands.append((low[order], own[order], seen))
            self.classes[int(c)] = bands

    def search(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and containment of verified matches."""
        parts = [self.long(texts)]
        for k, (values, items) in self.short.items():
            h, row = runs(texts, k)
            lo, hi = np.searchsorted(values, h, "left"), np.searchsorted(values, h, "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.unique(np.repeat(row, n) * len(self.ids) + items[which])
            parts.append((pair // len(self.ids), pair % len(self.ids), np.ones(len(pair))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def long(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the items of N words and more."""
        h, offs = shingled(texts)
        if not len(h) or not self.classes:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        rows = np.flatnonzero(np.diff(offs))
        base = min(self.classes)
        cuts, shapes = [], []
        count, start, step = np.diff(offs)[rows], offs[:-1][rows], base
        for c in (base << k for k in range(int(np.log2(max(self.classes) // base)) + 1)):
            blocks = -(-count // step)
            first = np.cumsum(blocks) - blocks
            at = np.repeat(start, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * step
            same = np.ones(len(at), bool)
            same[first[1:] - 1] = False
            same[-1] = False
            cuts.append(at)
            shapes.append((c, np.repeat(rows, blocks), np.flatnonzero(same[:-1])))
            count, start, step = blocks, first, 2
        found = []
        mask = (text.U(1) << self.bits) - text.U(1)
        for k, a in enumerate(_A):
            low = text.mix(h * a)
            for at, (c, row, pairs) in zip(cuts, shapes, strict=True):
                low = np.minimum.reduceat(low, at)
                if c not in self.classes:
                    continue
                window = low.copy()
                window[pairs] = np.minimum(low[pairs], low[pairs + 1])
                values, items, seen = self.classes[c][k]
                hit = np.flatnonzero(seen[window & mask])
                if len(hit):
                    lo, hi = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                    n = hi - lo
                    if n.any():
                        which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        found.append(np.repeat(row[hit], n) * len(self.ids) + items[which])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        row, item = pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))
        share = np.zeros(len(pairs))
        own: tuple[int, np.ndarray] = (-1, np.zeros(0, text.U))
        for i, (r, m) in enumerate(zip(row, item, strict=True)):
            if own[0] != r:
                own = r, np.sort(h[offs[r] : offs[r + 1]])
            s = self.h[self.offs[m] : self.offs[m + 1]]
            at = np.searchsorted(own[1], s)
            share[i] = (own[1][np.minimum(at, len(own[1]) - 1)] == s).mean()
        good = share >= THRESHOLD
        return row[good], item[good], share[good]


def indexes(benchmark: DataFrame):
    """The items in slices, each an index to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").dropDuplicates()
    n = items.count()
    parts = max(1, -(-n // SLICE))
    for k in range(parts):
        got = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Index(got["item_id"].to_numpy(), got["text"].combine_chunks())


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, doc_id, containment of every item in every document that reach the threshold."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for b in text.slices(whole, "text"):
                    row, item, share = index.search(b.column("text"))
                    yield pa.RecordBatch.from_arrays([pa.array(index.ids[item], pa.int64()), b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(np.round(share, 6))], ["item_id", "doc_id", "containment"])

        part = docs.mapInArrow(run, "item_id long, doc_id long, containment double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("containment").alias("containment"))


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no test item, with all their columns, without a shuffle."""
    schema = docs.schema
    for index in indexes(table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for whole in batches:
                for b in text.slices(whole, "text"):
                    clean = np.ones(b.num_rows, bool)
                    clean[index.search(b.column("text"))[0]] = False
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs


#: Words as the operators see them: the lower-case text cut at all but ASCII letters, digits and non-ASCII characters.
SQL_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"

ORACLE = rf"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i+{N - 1}], ' '))) AS s FROM d WHERE len(w) >= {N}),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i+{N - 1}], ' '))) AS s FROM b WHERE len(w) >= {N}),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
few AS (SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN {SHORTEST} AND {N - 1}),
fs AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM few) WHERE len(w) >= k)
SELECT item_id, doc_id, 1.0 AS containment FROM few JOIN fs USING (k, s) UNION ALL SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY item_id, doc_id HAVING count(*) / any_value(n) >= {THRESHOLD}
"""
