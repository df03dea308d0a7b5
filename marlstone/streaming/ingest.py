"""Streaming ingestion: files that arrive in a folder become chunks, each text once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.chunk import chunk


def arriving(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """path, text of new files, read whole."""
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("source"), text.clean_text(F.col("value")).alias("text"))


def ingest(stream: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Append documents (doc_id, source, checksum) and chunks under ``out``; texts already there are passed over.

    A micro-batch is written under its number, so that a repeated one replaces itself: with the
    checksum that is exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        d = batch.where("text <> ''").withColumn("checksum", text.checksum(F.col("text"))).dropDuplicates(["checksum"])
        try:
            known = spark.read.parquet(f"{out}/documents").where(F.col("batch") < number).select("checksum")
            d = d.join(known, "checksum", "left_anti")
        except Exception as error:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
                raise
        d = d.withColumn("doc_id", F.abs(F.xxhash64("checksum")) % (1 << 40)).persist()
        d.select("doc_id", "source", "checksum").write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        chunk(d).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        d.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
