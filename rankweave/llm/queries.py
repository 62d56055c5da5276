"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import leaks, licenses, main_text, media, mixing, quality, rule_ledger, simhash, spelling, tokens, url_filter, vector_codes, warc
from rankweave.runtime import table


def op1_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(warc.page_captures(table(spark, sf_dir, "pages")))
    return history.select(
        F.col("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to")
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judge(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc_history, op2_source_mix, op3_main_text, op4_token_counts, op5_media_tiles, op6_quality_knn, op7_simhash_trie, op8_license_rules, op9_template_leaks,
        op10_url_cascade, op11_rule_ledger, op12_spelling_variants, op13_vector_codes,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_history": warc.ORACLE, "op2_source_mix": mixing.ORACLE, "op8_license_rules": licenses.oracle(), "op10_url_cascade": url_filter.oracle(), "op11_rule_ledger": rule_ledger.ORACLE, "op13_vector_codes": vector_codes.oracle()}
