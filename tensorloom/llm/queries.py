"""Queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, language, packing, piece_codec, quality, rules, secret_scan, simhash, substring, token_count
from .oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir)).withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_documents(spark, sf_dir))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir, "lang"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_digests(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_score, op2_piece_codec, op3_quality_rules, op4_simhash, op5_secret_scan, op6_token_count, op7_substring, op8_language, op9_packing, op10_media)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
