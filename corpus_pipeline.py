"""Training-corpus pipeline: toxicity, near duplicates, benchmark contamination, secrets, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paysieve.llm import stages
from paysieve.llm.common import shared_folder, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.drop_contaminated),
    ("secret_scans", stages.mask_secrets),
    ("packing", stages.pack),
]

# The classifier, the character models, similarity components and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
