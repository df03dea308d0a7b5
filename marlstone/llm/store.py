"""Tables written in the cluster's shared folder: lineage is cut there, and a lost executor costs nothing.

The folder is ``spark.checkpoint.dir``. Where it is unset, a session of one machine
gets a folder under the working directory's ``spark-warehouse``; on a cluster that is an error.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch for Python workers.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared(spark: SparkSession) -> str:
    """The shared folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + os.path.abspath("spark-warehouse/shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    The driver then collects its garbage: what shuffles have left on the executors' disks goes with the last reference to them.
    """
    spark = df.sparkSession
    at = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    schema = df.schema
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and that nothing lazy reads any more."""
    sc = df.sparkSession.sparkContext
    for f in df.inputFiles()[:1]:
        path = sc._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH) == "67108864b":  # its default; long texts fill a batch of that size many times over in the workers
        spark.conf.set(_BATCH, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
