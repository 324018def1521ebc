"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, near_dedup, pii, quality, suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_index import token_index

    return token_index(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, digest

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(contamination(documents, _table(spark, sf_dir, "benchmark")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secret_spans

    return digest(secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, personal_data

    return digest(personal_data(_table(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import CONTRACT, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), rule=CONTRACT)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest, repeated

    return digest(repeated(_table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(documents, tokenizer_file("piece_bpe_32k.model"), verify=True).drop("text")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .licences import licences

    # The table has no paths, so there is nothing to inherit from.
    return licences(_table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("path"), "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_quality_rules": op2_quality_rules,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op10_personal_data": op10_personal_data,
    "op3_near_dedup": op3_near_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_sentencepiece": op7_sentencepiece,
    "op4_licence_scan": op4_licence_scan,
}

ORACLES: dict[str, str] = {"op2_quality_rules": quality.ORACLE, "op8_benchmark_decontamination": decontaminate.ORACLE, "op3_near_dedup": near_dedup.ORACLE, "op9_suffix_dedup": suffix_dedup.ORACLE, "op10_personal_data": pii.ORACLE}
