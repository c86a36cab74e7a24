"""Documents to training shards: quality rules, near-duplicates, benchmark items, mixture, training order.

Each stage takes (spark, docs, folder of tables) and returns what the next one reads; ``run`` writes every stage but the last to the
shared folder, so a lost executor costs no more than its stage, and removes what the stage before wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colmetry.llm import decontamination, line_quality, mixing, simhash, training_order
from colmetry.llm.texts import delete_staged, scratch, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, and documents that fail or lose too much go altogether."""
    return line_quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their target shares."""
    return mixing.sample(docs)


def training_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in training order below the shared folder; returns the manifest, one row per record."""
    return training_order.materialise(docs, f"{scratch(spark)}/shards")[0]


STAGES = [
    ("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark),
    ("mixing to target weights", mixture), ("training order", training_shards),
]

# SimHash needs XXH64 and the shards a keyed permutation: SQL has neither. tests/llm/test_pipeline.py states the result in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
        if last is not None:
            delete_staged(last)
        last = docs
    shards = STAGES[-1][1](spark, docs, sf_dir)
    delete_staged(docs)
    return shards
