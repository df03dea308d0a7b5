"""A corpus from raw documents to pieces: five stages, each over all rows that the one before kept.

toxicity: documents of a toxicity of at least the classifier's threshold go. near_duplicates: of each group of documents
connected by n-gram Jaccard similarity the one with the least doc_id stays. decontamination: documents that hold a
benchmark item go. personal_data: spans are replaced by their kind. pieces: ids and N-best segmentations.

All stages but the last return the columns of documents, whatever they are, as long as doc_id and text are among them.
Each stage's table is written as Parquet in the shared folder and read again by the next. Rows without a text or an id
pass all stages; an empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, jaccard, pieces, pii, toxicity
from marlstone.llm.store import stored, table

STAGES = [
    ("toxicity", toxicity.filter_stage),
    ("near_duplicates", jaccard.filter_stage),
    ("decontamination", decontaminate.filter_stage),
    ("personal_data", pii.filter_stage),
    ("pieces", pieces.encode_stage),
]

#: SQL can express neither the classifier nor the random field; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
