"""A training-corpus pipeline of five operators, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, jaccard_join, language_id, queries, sentence_spans, sentencepieces
from corpusloom.llm.common import Scratch, fresh


#: words in the store of an encoding task: fewer than where the operator has an executor to itself
WORDS_KEPT = 300_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, those without a letter and those in none of the languages labelled go."""
    return language_id.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 of five-word shingles the smallest id stays."""
    return jaccard_join.keep_first(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentences are cut from the texts; a text that had nothing else goes."""
    names, removed = [f"`{c}`" for c in docs.columns], fresh(docs, "__removed")
    cut = sentence_spans.remove_repeats(docs, removed_col=removed)
    cut = cut.filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in docs.columns else cut.select(*names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.without_leaks(docs, queries.read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether these decode to the text."""
    coded = sentencepieces.encode(docs, queries.tokenizer(), words_kept=WORDS_KEPT)
    decoded = fresh(coded, "__decoded")
    coded = sentencepieces.decode(coded, queries.tokenizer(), text_col=decoded)
    return coded.withColumn("round_trip", F.coalesce(F.col(decoded) == F.col("text"), F.lit(False))).drop(decoded)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("sentence_spans", drop_repeated_spans),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = queries.read(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
