"""Driver queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import audio, bpe, chat, html_blocks, near_dedup, packing, quality, secrets, suffix_dedup, toxicity
from tideline.llm.common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.trained(documents, read(spark, sf_dir, "labels")))


def op3_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.main_text(read(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.spans(read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(read(spark, sf_dir, "conversations"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return audio.matches(audio.played_fingerprints(vectors), vectors.where("id % 20 = 0").select("id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_toxicity, op3_html_blocks, op4_suffix_dedup, op5_near_dedup, op6_byte_bpe, op7_chat, op8_secrets, op9_packing, op10_chroma)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality": quality.oracle(), "op8_secrets": secrets.oracle()}
