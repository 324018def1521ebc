"""The corpus pipeline: documents go through quality rules, near-duplicate removal, benchmark decontamination, secret
redaction and SentencePiece encoding. Each stage is written as Parquet in the shared folder and read again, so a lost
executor costs one stage's tasks at most.

Rejected documents go; of each group of near copies (shingles of five words, similarity of 0.8 or more) one document stays; a document in which windows of two or more
benchmark items occur goes, and the passages of a single item are cut out of the text; secrets are replaced in the
text, with n_chars of the new text; the last stage gives each document's ids. All stages but the last return the
columns of documents, and those of the table that have further or clashing names as they are.

Null and empty texts fail the base rules and go in the first stage. Null languages and sources are groups of their own; null
ids are kept. Texts of any length go through whole. Of documents that tie for a group's least id, and of repeated rows, one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import stored, text_batches
from ledgerline.llm.decontaminate import decontaminated
from ledgerline.llm.near_dedup import FIVE, deduplicated
from ledgerline.llm.pieces import encoded
from ledgerline.llm.quality import accepted
from ledgerline.llm.queries import tokenizer_file
from ledgerline.llm.secrets import without_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_batches(spark)  # what a stage returns runs later, with the session's settings
    return accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs, rule=FIVE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs.select("doc_id", "text", "lang", "source"), tokenizer_file("piece_bpe_32k.model"), verify=True).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]

#: Viterbi segmentation and compression novelty have no SQL form; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
