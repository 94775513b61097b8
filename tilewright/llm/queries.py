"""The driver's queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import chat, jaccard, linededup, mih, mixing, quality, sentencepieces, suffixes, tokenfile, urlfilter
from tilewright.llm.common import documents


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.op1_sentencepiece(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op2_ngram_jaccard(documents(spark, sf_dir))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op3_token_output(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4_mixing(documents(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op5_chat_formatting(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.op6_nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op7_line_dedup(documents(spark, sf_dir))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op8_url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9_quality_rules(documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op10_suffix_dedup(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_output": op3_token_output,
    "op4_mixing": op4_mixing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op7_line_dedup": linededup.OP7_SQL,
    "op8_url_filters": urlfilter.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_suffix_dedup": suffixes.OP10_SQL,
}
