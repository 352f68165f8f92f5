"""The corpus pipeline: documents in, token ids out, one written table a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import langid, linededup, mixing, pieces, simhash
from quillspan.llm._common import remove, scratch, scratch_removed

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", pieces.stage),
]

#: SQL expresses neither the fitted language model nor XXH64 fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet to the shared folder and read again.

    A stage's own scratch tables, and the stage before it, are removed once it is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with scratch_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
