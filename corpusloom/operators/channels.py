"""Channels of retrieval that keep to each question's window of time.

Questions are (query_id, text, begin_at, end_at, entities): a window is half open, null bounds are none;
entities are names in it. Documents are (doc_id, at, text). Postings are written once, by day and within a day by
term, so that a window's join prunes the days that no question touches.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import search_tokens
from corpusloom.operators.graph import Rounds

#: a term of a name counts so often; terms in more than this part of all documents don't count
ENTITY, COMMON, SLOTS = 3.0, 0.15, 16


class Index(NamedTuple):
    postings: DataFrame  # day, term, doc_id, at
    terms: DataFrame  # term, weight: those that count


def _day(at: Column) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(at) / 86_400), F.lit(-1)).cast("int")


def write_index(docs: DataFrame, rounds: Rounds, common: float = COMMON) -> Index:
    """Postings by day, with terms that are too common left out of them: they could never count."""
    rows = docs.select("doc_id", "at", F.explode(search_tokens(F.col("text"))).alias("term"))
    df = rounds.save(rows.groupBy("term").agg(F.count("*").alias("df")), "df")
    total = docs.count()
    terms = df.filter(F.col("df") <= max(1, int(total * common))).select("term", F.log(F.lit(total) / F.col("df")).alias("weight"))
    kept = rows.join(terms.select("term"), "term").withColumn("day", _day(F.col("at")))
    kept = kept.repartition("day", F.pmod(F.xxhash64("term"), F.lit(SLOTS))).sortWithinPartitions("day", "term").select("term", "doc_id", "at", "day")
    path = f"{rounds.root}/postings"
    kept.write.mode("overwrite").partitionBy("day").parquet(path)
    return Index(docs.sparkSession.read.schema(kept.schema).parquet(path), terms)


def days_of(questions: DataFrame) -> DataFrame:
    """A row for each day that a question's window touches, cut: whether it holds only a part of that day; those without a window have none."""
    last = F.col("end_at") - F.expr("INTERVAL 1 MICROSECOND")
    rows = questions.filter("begin_at < end_at").withColumn("day", F.explode(F.sequence(_day(F.col("begin_at")), _day(last))))
    begins = F.timestamp_seconds(F.col("day").cast("long") * 86_400)
    return rows.withColumn("cut", (begins < F.col("begin_at")) | (begins + F.expr("INTERVAL 1 DAY") > F.col("end_at")))


def inside(at: str = "at") -> Column:
    return (F.col(at) >= F.col("begin_at")) & (F.col(at) < F.col("end_at"))


def sparse_topk(questions: DataFrame, index: Index, k: int = 40) -> DataFrame:
    """query_id, doc_id, score, rank: the sum of ln(N / df) over distinct terms that match, thrice for those of names, in the question's window."""
    names = F.transform("entities", lambda e: F.lower(e))
    terms = questions.select("query_id", "begin_at", "end_at", F.explode(search_tokens(F.col("text"))).alias("term"), names.alias("names"))
    terms = terms.join(index.terms, "term").withColumn("weight", F.when(F.array_contains("names", F.col("term")), ENTITY * F.col("weight")).otherwise(F.col("weight"))).drop("names")
    windowed = days_of(terms).join(index.postings, ["day", "term"]).filter(inside()).select("query_id", "doc_id", "weight")
    open_ = terms.filter("begin_at is null").join(index.postings, "term").select("query_id", "doc_id", "weight")
    scores = windowed.union(open_).groupBy("query_id", "doc_id").agg(F.round(F.sum("weight"), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def temporal_topk(questions: DataFrame, docs: DataFrame, k: int = 40, of_entities: bool = False) -> DataFrame:
    """query_id, doc_id, rank: the newest documents (doc_id, at, subject) in the question's window; of_entities: only those whose subject it names.

    Of a day that lies within a window whole, only its newest k can be among these (with names: its newest k of each subject).
    """
    rows = docs.filter("at is not null").select("doc_id", "at", "subject", _day(F.col("at")).alias("day"))
    newest = W.partitionBy("day", *(["subject"] if of_entities else [])).orderBy(F.desc("at"), F.desc("doc_id"))
    heads = rows.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= k).drop("__r")
    asked, on = days_of(questions).select("query_id", "begin_at", "end_at", "day", "cut", "entities"), ["day"]
    if of_entities:
        asked = asked.withColumn("subject", F.explode(F.array_distinct("entities"))).filter("subject <> ''")
        on = ["day", "subject"]
    asked = asked.drop("entities")
    met = asked.filter("cut").join(rows, on).filter(inside()).select("query_id", "doc_id", "at").union(asked.filter("not cut").join(heads, on).select("query_id", "doc_id", "at"))
    order = W.partitionBy("query_id").orderBy(F.desc("at"), F.desc("doc_id"))
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")
