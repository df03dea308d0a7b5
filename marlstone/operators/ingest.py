"""Ingestion: checksums, duplicates, versions, reuse of earlier chunks, and maintenance of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def with_checksum(docs: DataFrame) -> DataFrame:
    return docs.withColumn("checksum", text.checksum("text"))


def rejected(docs: DataFrame) -> DataFrame:
    """Policy reject: of equal texts the least doc_id stays; checksum, doc_id, copies."""
    return with_checksum(docs.where("text is not null")).groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def versions(docs: DataFrame) -> DataFrame:
    """Policy new version: doc_id, root_id, version, previous_id among equal texts, by doc_id."""
    by = W.partitionBy("checksum").orderBy("doc_id")
    d = with_checksum(docs.where("text is not null")).select("doc_id", "checksum")
    return d.select("doc_id", F.first("doc_id").over(by).alias("root_id"), F.row_number().over(by).cast("long").alias("version"), F.lag("doc_id").over(by).alias("previous_id"))


def reuse_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each document against the one before it from the same source: chunks added, updated (never), removed, unchanged.

    A chunk is unchanged, and its vector reused, if a chunk of the earlier document has the same content hash.
    """
    earlier = docs.select("doc_id", F.lag("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("earlier_id"))
    own = chunks.select("doc_id", text.checksum("content").alias("hash"))
    known = own.select(F.col("doc_id").alias("earlier_id"), "hash").distinct().withColumn("known", F.lit(1))
    counts = chunks.groupBy(F.col("doc_id").alias("earlier_id")).agg(F.count("*").alias("before"))
    joined = earlier.join(own, "doc_id", "left").join(known, ["earlier_id", "hash"], "left")
    per = joined.groupBy("doc_id", "earlier_id").agg(F.count("hash").alias("total"), F.count("known").alias("unchanged"))
    per = per.join(counts, "earlier_id", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return per.select("doc_id", (F.col("total") - F.col("unchanged")).alias("added"), F.lit(0).cast("long").alias("updated"), F.greatest(F.lit(0).cast("long"), F.col("before") - F.col("unchanged")).alias("removed"), "unchanged")


def indexed(pending: DataFrame, existing: DataFrame) -> DataFrame:
    """Status of pending documents: failed without text, duplicate of an existing or earlier pending one, else indexed."""
    d = with_checksum(pending)
    first = F.row_number().over(W.partitionBy("checksum").orderBy("doc_id")) > 1
    known = with_checksum(existing.where("text is not null")).select("checksum").distinct().withColumn("known", F.lit(True))
    d = d.withColumn("later", first & F.col("checksum").isNotNull()).join(known, "checksum", "left")
    blank = F.coalesce(text.trim("text"), F.lit("")) == ""
    return d.select("doc_id", F.when(blank, "failed").when(F.col("known") | F.col("later"), "duplicate").otherwise("indexed").alias("status"))


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the documents of ``gone`` (doc_id): deletion as a rewrite."""
    return df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def fingerprint(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts that change whenever the tables do: a cache key."""
    d = docs.agg(F.count("*").alias("documents"), F.max("doc_id").alias("last_document"))
    return d.crossJoin(chunks.agg(F.count("*").alias("chunks"), F.max("chunk_id").alias("last_chunk")))
