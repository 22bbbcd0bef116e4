"""The queries of this subpackage: name -> f(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, filters, fingerprints, licenses, minhash, packing, quality, resampling, sharding, simhash, substrings, suffixes, token_counts
from .common import read
from .oracles import ORACLE_SQL


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, similarity=Fraction(85, 100))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(read(spark, sf_dir, "documents"), size=400)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).where("not whole").drop("whole")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_sharding, op3_decontamination, op4_fingerprints, op5_packing,
        op6_suffix_dedup, op7_token_counts, op8_substring_dedup, op9_license_scan, op10_quality_classifier,
        op11_filter_audit, op12_resampling, op13_simhash_dedup,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
