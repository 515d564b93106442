"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, mixing and token output.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; all but the last
keep the columns of documents. run() writes each stage's rows as Parquet in the shared checkpoint folder and reads them
again for the next, so a lost executor or a failed stage costs that stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapweave.llm import decontam, mixing, near, quality, tokens
from snapweave.llm.common import new_folder, small_batches


#: Pieces that a worker of the token stage remembers: fewer than by itself, as executors hold what the stages before left.
PIECES = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filtered(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id (five words, 0.8)."""
    small_batches(spark)
    return near.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole repetition that the mix takes, and one for the part at a bucket's edge."""
    return mixing.repeated(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of all rows in shards with an index, and what they hold by document."""
    return tokens.written(docs, PIECES)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: SQL can express neither the LSH stage's confirmation at scale nor the encoding; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
