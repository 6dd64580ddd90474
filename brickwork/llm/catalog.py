"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickwork.llm import ann, classlm, cleaning, infill, langid, licenses, mixing, packing, pii, simhash, spelling, tokencounts, toxicity
from brickwork.llm.shared import documents

#: Vocabulary of the packing query, and the same as merge ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Vocabulary of the token counts.
COUNTED = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens, with the sources in proportion."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.predicted(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return cleaning.quality(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(documents(spark, sf_dir)).drop("found")


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and class-model scores of every document."""
    return classlm.scored(documents(spark, sf_dir))


def op9_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every hundredth id."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document."""
    return pii.scanned(documents(spark, sf_dir))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and the text rebuilt from it, as digests."""
    return infill.digests(documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, form and root."""
    return spelling.grouped(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokencounts.counted(documents(spark, sf_dir), public_tokenizers.path(COUNTED))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed pieces."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    every = (op1_packing, op2_language_id, op3_mixing, op4_toxicity, op5_simhash, op6_quality_rules, op7_license_scan, op8_class_lm, op9_graph_ann, op10_personal_data, op11_infill, op12_spelling, op13_token_counts, pipeline)
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.SQL, "op6_quality_rules": cleaning.SQL, "op11_infill": infill.SQL, "op12_spelling": spelling.SQL}
