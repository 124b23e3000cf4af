"""Queries and SQL of this subpackage, for registration at the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.secrets import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_tk", "whole")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestar.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.flac import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("_tk")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_language_id, op4_decontamination, op5_line_dedup, op6_sentencepiece, op7_suffix_array_dedup, op8_flac, op9_minhash_near_dedup, op10_warc)}


def oracle_sql() -> dict[str, str]:
    from lodestar.llm import decontam, line_dedup, warc

    return {"op4_decontamination": decontam.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op10_warc": warc.ORACLE}
