"""Suffix-array dedup: passages of at least ``LEAST`` words that documents share, from merged shard BWTs.

A shard is a task's documents. It doesn't sort all its suffixes, only those that can
begin a shared passage, at sampled places: of each ``LEAST``-word window the place whose next ``KEY`` words have
the smallest hash (a minimizer), so that equal windows have the same place wherever they stand.
A first pass counts, over all documents, in how many rows each ``KEY``-word prefix occurs; suffixes whose
prefix is in one row only are dropped by a bit table of the others (of bounded size; a
false positive costs a row of shuffle and changes nothing, and beyond ``MOST_KEYS`` the table is left out).

A shard's transform is, for each suffix kept, its prefix key, the symbols that follow (to depth
``LEAST``) and those that precede it (the BWT symbol and the ones before that, as backward
steps would read them). Key ranges of all shards meet in one task, which merges them
by iterative interleave refinement: suffixes start in one interval for each key (common
prefix ``KEY``); each iteration splits intervals by the next symbol, only where an interval still
holds several suffixes, and the iteration in which neighbours part is their common prefix. The same
refinement by preceding symbols extends intervals to the left, as a backward search does.
An interval of left depth l and right depth ``LEAST - KEY - l`` that holds suffixes of two or
more rows is a repeated window. Windows that overlap are joined to passages.

Words are counted from 0 in the lower-case text. Defined cases: null, empty and short texts have no
passages; a passage that repeats only within its row isn't reported; a row that occurs twice
counts as two documents; null ids are dropped; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text
from .decontaminate import SQL_WORDS
from .store import stored, table

LEAST, KEY = 50, 32
SIDE = LEAST - KEY
MOST_KEYS = 1 << 26
_LOW = text.U((1 << 30) - 1)


def anchors(h: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word indexes of the sampled suffixes, and their keys, for rows of words given by hashes."""
    p, inv = text.powers(len(h) + 1)
    s = np.empty(len(h) + 1, text.U)
    s[0] = 0
    np.cumsum(h * p[:-1], out=s[1:])
    n = len(h) - KEY + 1
    if n <= SIDE:
        return np.zeros(0, np.int64), np.zeros(0, text.U)
    key = text.mix((s[KEY:] - s[:-KEY]) * inv[:n])
    low = ((key >> text.U(30)) << text.U(30)) | (_LOW - np.arange(n, dtype=text.U))
    done = 1
    while done < SIDE + 1:
        step = min(done, SIDE + 1 - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    size = np.diff(woffs)
    whole = np.maximum(0, size - LEAST + 1)
    first = np.repeat(woffs[:-1] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
    at = (_LOW - (low[first] & _LOW)).astype(np.int64)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        at = at[new]
    return at, key[at]


def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text.raw(batch.column("text"), lower=True)
    starts, ends, woffs = text.words(data, offs)
    return text.word_hashes(data, starts, ends), woffs


def refine(block: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Interval numbers after the next symbol; a number under 0 marks an interval of one suffix, which needs no more iterations."""
    live = np.flatnonzero(block >= 0)
    out = np.full(len(block), -1, np.int64)
    if len(live):
        order = live[np.lexsort((symbol[live], block[live]))]
        b, s = block[order], symbol[order]
        new = np.ones(len(order), bool)
        new[1:] = (b[1:] != b[:-1]) | (s[1:] != s[:-1])
        number = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        out[order] = np.where(alone, -1, number)
    return out


def merged(key: np.ndarray, row: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that lie in repeated windows, with the start and end of their union.

    left[i, k] is the k-th symbol before suffix i, right[i, k] the k-th after its key; 0 is none.
    """
    start_all = refine(np.zeros(len(key), np.int64), key)
    rights, lefts = [start_all], [start_all]
    for k in range(SIDE):
        for side, symbols in ((rights, right), (lefts, left)):
            nxt = refine(side[-1], symbols[:, k])
            nxt[symbols[:, k] == 0] = -1
            side.append(nxt)
    begin, end = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), -1, np.int64)
    for l in range(SIDE + 1):
        a, b = lefts[l], rights[SIDE - l]
        live = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(live):
            continue
        order = live[np.lexsort((row[live], b[live], a[live]))]
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(order)) - 1
        shared = row[order[first]] != row[order[last]]
        hit = order[np.repeat(shared, last - first + 1)]
        begin[hit] = np.minimum(begin[hit], at[hit] - l)
        end[hit] = np.maximum(end[hit], at[hit] - l + LEAST)
    found = np.flatnonzero(end >= 0)
    return found, begin[found], end[found]


def duplicated(docs: DataFrame) -> DataFrame:
    """Keys that are in two or more rows."""

    def run(batches):
        for whole in batches:
            for b in text.slices(whole, "text"):
                h, woffs = hashed(b)
                at, key = anchors(h, woffs)
                key, _ = text.distinct(key, np.searchsorted(at, woffs))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def bit_table(keys: DataFrame) -> tuple[int, np.ndarray] | None:
    """A table of bits of the keys' leading bits; None where there are too many keys for one of bounded size."""
    n = keys.count()
    if n > MOST_KEYS:
        return None
    bits = int(np.clip(np.ceil(np.log2(16 * n + 1)), 16, 30))
    seen = np.zeros(1 << max(0, bits - 3), np.uint8)
    got = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("b")).distinct().toArrow()["b"].to_numpy()
    np.bitwise_or.at(seen, got >> 3, np.left_shift(1, got & 7).astype(np.uint8))
    return bits, seen


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive) of every maximal shared passage."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    shared = spark.sparkContext.broadcast(bit_table(stored(duplicated(docs), "keys")))

    def suffixes(batches):
        bits = shared.value
        part = 0
        for whole in batches:
            for b in text.slices(whole, "text", 1 << 20):
                h, woffs = hashed(b)
                at, key = anchors(h, woffs)
                if bits is not None:
                    k = (key >> text.U(64 - bits[0])).astype(np.int64)
                    keep = (bits[1][k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
                    at, key = at[keep], key[keep]
                owner = np.searchsorted(woffs, at, "right") - 1
                symbols = np.concatenate([np.zeros(SIDE, np.uint32), ((h >> text.U(32)) | text.U(1)).astype(np.uint32), np.zeros(SIDE + KEY, np.uint32)])
                j = np.arange(SIDE)
                before, after = at[:, None] - 1 - j, at[:, None] + KEY + j
                left = np.where(before >= woffs[owner][:, None], symbols[before + SIDE], 0)
                right = np.where(after < woffs[owner + 1][:, None], symbols[after + SIDE], 0)
                context = np.ascontiguousarray(np.concatenate([left, right], axis=1).astype(np.uint32)).view("S%d" % (8 * SIDE)) if len(at) else np.zeros(0, "S1")
                buffer = context.tobytes() if len(at) else b""
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), b.column("doc_id").take(pa.array(owner)), pa.array(owner + part), pa.array((at - woffs[owner]).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(0, (len(at) + 1) * 8 * SIDE, 8 * SIDE, dtype=np.int32).tobytes()), pa.py_buffer(buffer)])],
                    ["key", "doc_id", "line", "at", "context"],
                )
                part += b.num_rows

    kept = docs.mapInArrow(suffixes, "key long, doc_id long, line long, at int, context binary")
    kept = kept.withColumn("line", F.xxhash64("doc_id", "line", F.spark_partition_id()))

    def merge(batches):
        rest = None
        for b in batches:
            whole = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = whole["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if cut:
                yield from solved(whole.slice(0, cut))
            rest = whole.slice(cut)
        if rest is not None and rest.num_rows:
            yield from solved(rest)

    def solved(rows: pa.Table):
        rows = rows.combine_chunks()
        context = rows["context"].chunk(0)
        offs = np.frombuffer(context.buffers()[1], np.int32)[context.offset : context.offset + len(context) + 1]
        symbols = np.frombuffer(context.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(np.uint32).reshape(len(context), 2 * SIDE)
        found, begin, end = merged(rows["key"].to_numpy(), rows["line"].to_numpy(), rows["at"].to_numpy().astype(np.int64), symbols[:, :SIDE], symbols[:, SIDE:])
        yield pa.RecordBatch.from_arrays([rows["doc_id"].chunk(0).take(pa.array(found)), rows["line"].chunk(0).take(pa.array(found)), pa.array(begin), pa.array(end)], ["doc_id", "line", "start_word", "end_word"])

    parts = kept.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "doc_id long, line long, start_word long, end_word long")
    by = W.partitionBy("doc_id", "line").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by.rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("new", (F.col("start_word") > F.coalesce(reach, F.lit(-1))).cast("int"))
    parts = parts.withColumn("number", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return parts.groupBy("doc_id", "line", "number").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).select("doc_id", "start_word", "end_word")


def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS line, doc_id, {SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT line, doc_id, w, unnest(range(0, len(w) - {LEAST - 1})) AS i FROM d WHERE len(w) >= {LEAST}),
g AS (SELECT line, doc_id, i, md5(array_to_string(w[i+1:i+{LEAST}], ' ')) AS h FROM e),
s AS (SELECT h FROM g GROUP BY h HAVING min(line) < max(line)),
p AS (SELECT line, doc_id, i FROM g WHERE h IN (SELECT h FROM s)),
q AS (SELECT line, doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {LEAST} THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT line, doc_id, i, sum(new) OVER (PARTITION BY line ORDER BY i ROWS UNBOUNDED PRECEDING) AS number FROM q)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start_word, CAST(max(i) + {LEAST} AS BIGINT) AS end_word FROM r GROUP BY line, doc_id, number
"""
