"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage
before kept, and its result is written and read again before the next one. All stages but the last
return the columns of docs unchanged.

Rejected: documents predicted to be toxic (score of 0.7 or more); all but the largest doc_id of
equal texts; all but the smallest doc_id of a SimHash component; contaminated documents. Equal and
near-equal texts may sit anywhere in the corpus. An empty table runs through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from tidemark.llm.shared import documents, dropped, kept, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier, the components and the packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch():  # what a stage has written on its way goes; so does its input once its result is there
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}", stay=True)
        if before is not None:
            dropped(before)
        before = docs
    return docs
