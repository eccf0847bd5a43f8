"""Queries of the text operators, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapegrid.llm import bpe, licenses, lm, packing, quality, secrets, simhash, sites, substring, toxicity, treap, variants, weighted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(documents(spark, sf_dir))


@query
def op2_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@query
def op3_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir), tokenizer())


@query
def op6_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.report(documents(spark, sf_dir))


@query
def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


@query
def op8_toxicity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(documents(spark, sf_dir), tokenizer())


@query
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(documents(spark, sf_dir))


@query
def op11_chunk_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(documents(spark, sf_dir))


ORACLES["op11_chunk_variants"] = variants.ORACLE


@query
def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLES["op12_treap_search"] = treap.ORACLE


@query
def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))
