"""Training-data pipeline over ``documents``: quality rules, near-dedup, substring dedup, secret scan, packing.

Each stage is written as Parquet to the shared folder and read again by the next. All but the last return the columns
of documents; the last returns one row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapegrid.llm import near, packing, quality, secrets, simhash, substring
from tapegrid.llm.queries import tokenizer
from tapegrid.plans.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the calibrated forest keep."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: groups by fingerprints at most two bits apart, then, of what
    they leave, by a five-word Jaccard similarity of 0.8 or more (such pairs often differ in more bits)."""
    return near.keep_first(materialise(simhash.keep_first(docs), "fingerprints"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that holds them."""
    return substring.remove(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked; examples that many owners copied stay."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024."""
    return packing.report(docs, tokenizer())


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Forest, fingerprints, alignment and tokens have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
