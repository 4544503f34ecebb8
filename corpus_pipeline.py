"""A training-data pipeline over `documents`: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Every stage takes what its predecessor kept, written as Parquet and read again, so a lost executor costs no more than its tasks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, mixing, neardup, quality, sharding
from tidegraph.llm._common import alone, drop, table

SHARDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more stays, that of the smallest id."""
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot; the text's CRC and size tell what goes there."""
    return sharding.sharded(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The same by DuckDB, each stage over what the one before it kept: for a table of documents whose ids are there and differ.
ORACLE_SQL = f"""
WITH good AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({quality.sql()}) USING (doc_id) WHERE kept),
single AS MATERIALIZED (SELECT d.* FROM good d JOIN ({neardup.sql("good", neardup.THRESHOLD)}) USING (doc_id) WHERE kept),
clean AS MATERIALIZED (SELECT d.* FROM single d JOIN ({decontaminate.sql("single")}) USING (doc_id) WHERE NOT contaminated),
mixed AS MATERIALIZED (SELECT * EXCLUDE (copies, n) FROM (SELECT d.*, copies, unnest(range(copies)) AS n FROM clean d JOIN (SELECT doc_id, copies FROM ({mixing.sql("clean")})) USING (doc_id)))
SELECT * FROM ({sharding.sql("mixed", SHARDS)})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = alone(partial(stage, spark, docs, sf_dir))
        drop(*last)  # of each stage its result alone is held, and that only until the next one has read it
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
