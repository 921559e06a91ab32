"""The registered queries of the training-data operators: thin wrappers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, html_blocks, language, patterns, pieces, pii, secrets, simhash, spelling, suffixes, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(_table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling(_table(spark, sf_dir, "documents"))


def op12_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.recoveries(_table(spark, sf_dir, "clicks"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_pii, op4_language, op5_fingerprint, op6_pieces, op7_toxicity, op8_simhash, op9_suffixes, op10_urls, op11_spelling, op12_patterns, op13_html)}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op10_urls": urls.ORACLE, "op12_patterns": patterns.ORACLE}
