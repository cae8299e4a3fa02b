"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_main, jaccard, langid, lm, media, packing, suffix, tokens_out, urls


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op2_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_read(spark, sf_dir, "documents"))


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_read(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(_read(spark, sf_dir, "documents"))


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary())


def op6_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op8_parquet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_out.round_trip(_read(spark, sf_dir, "documents"), vocabulary())


def op9_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op6_redirect_equivalence": urls.oracle(), "op10_containment_search": decontam.ORACLE}
