"""The registered queries of this folder, with SQL where SQL can express them."""

from __future__ import annotations

import os
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, conversations, decontamination, jaccard_join, language_id, licenses, packing, sentence_spans, sentencepieces, spelling, telephony, token_counts, url_filter


def tokenizer(name: str = "piece_bpe_32k.model", variable: str = "CORPUSLOOM_TOKENIZER") -> str:
    import public_tokenizers

    return os.environ.get(variable) or public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encoded_documents(read(spark, sf_dir, "documents"), tokenizer())


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.telephony_digests(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op6_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scored(read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), 3, Fraction(9, 10))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer())


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.remove_repeats(docs)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.misspelt_documents(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_repairs(read(spark, sf_dir, "conversations"))


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json", "CORPUSLOOM_BYTE_TOKENIZER"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_telephony,
        op3_url_filter,
        op4_decontamination,
        op5_license_scan,
        op6_katz_backoff,
        op7_jaccard_join,
        op8_token_counts,
        op9_sentence_spans,
        op10_language_id,
        op11_spelling_variants,
        op12_conversation_repair,
        op13_mixture_packing,
    )
}

ORACLE_SQL: dict[str, str] = {}
