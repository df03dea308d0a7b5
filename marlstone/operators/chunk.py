"""Chunks of documents: overlapping windows, parents, and texts put together again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.batches import portions

#: A chunk's id holds its document's id and its position; no string has as many chunks of the default size.
SPAN = 1 << 22


def cut(t: str, size: int, overlap: int) -> list[str]:
    """The chunks of one text. Window k starts at k * (size - overlap) of the trimmed text; all but the last are cut after
    the last blank line, line end, sentence end or space of their second half, whichever is found first in that order; blank ones are left out."""
    t, out, start = t.strip(text.BLANKS), [], 0
    while t:
        window = t[start : start + size]
        if start + size < len(t):
            for needle in ("\n\n", "\n", ". ", " "):
                at = window.rfind(needle)
                if at >= size // 2:
                    window = window[: at + len(needle)]
                    break
        if window := window.strip(text.BLANKS):
            out.append(window)
        if start + size >= len(t):
            break
        start += size - overlap
    return out


def chunk(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """chunk_id, doc_id, position, content, as ``cut`` has it, some megabytes of an Arrow batch at a time; null and blank texts have no chunks, equal
    rows have equal chunks, and a null doc_id gives null ids."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to less than size")

    def run(batches):
        for b in (x for b in batches for x in portions(b, "text")):
            parts = [cut(t, size, overlap) if t else [] for t in b.column("text").to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            own = b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
            position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([own, pa.array(position.astype(np.int32)), pa.array([x for p in parts for x in p], pa.string())], ["doc_id", "position", "content"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = d.mapInArrow(run, "doc_id long, position int, content string")
    return out.select((F.col("doc_id") * SPAN + F.col("position")).alias("chunk_id"), "doc_id", "position", "content")


def in_order(by: str, what: str) -> F.Column:
    """An array of a group's values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[what])


def parents(chunks: DataFrame, window: int = 4) -> DataFrame:
    """doc_id, parent, first and number of children, content: each run of ``window`` chunks as one."""
    by = chunks.groupBy("doc_id", F.floor(F.col("position") / window).cast("long").alias("parent"))
    return by.agg(F.min("position").alias("first_position"), F.count("*").alias("children"), F.array_join(in_order("position", "content"), "\n\n").alias("content"))


def document_text(chunks: DataFrame, limit: int = 6000) -> DataFrame:
    """doc_id and the first ``limit`` characters of its chunks in order."""
    filled = chunks.withColumn("content", text.trim("content")).where("content <> ''")
    return filled.groupBy("doc_id").agg(F.substring(F.array_join(in_order("position", "content"), "\n\n"), 1, limit).alias("text"))


def section(chunks: DataFrame, term: str, limit: int = 5000) -> DataFrame:
    """As ``document_text``, of the chunks that contain the term; a blank term means all."""
    term = term.strip().lower()
    return document_text(chunks.where(F.contains(F.lower("content"), F.lit(term))) if term else chunks, limit)
