"""Reading the tables and binding them to the article model; the same bindings as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
ZONE = "Asia/Shanghai"
# Tiers of sources and types of content.
TIERS = ["primary", "secondary", "expert", "community"]
CONTENT_TYPES = ["model_release", "product_release", "api_update", "research", "open_source", "security", "policy", "business", "tutorial", "opinion"]


def read_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    n = F.substring("source", 4, 10).cast("int")
    found = docs.select(F.col("source").alias("source_id"), n.alias("n")).distinct()
    return found.select("source_id", "n", _pick(TIERS, F.col("n") % 4).alias("tier"), F.concat(F.lit("org"), F.floor(F.col("n") / 2).cast("string")).alias("organization"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, events, labels = read_tables(spark, sf_dir, "documents", "events", "labels")
    observed = events.select(F.col("event_id").alias("doc_id"), F.col("ts").alias("observed_at"))
    quality = labels.select("doc_id", (F.col("quality") * 60 + 20).cast("double").alias("quality"))
    return (
        docs.join(observed, "doc_id")
        .join(quality, "doc_id", "left")
        .select(
            F.col("doc_id").alias("item_id"),
            F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
            F.col("text").alias("body"),
            F.col("source").alias("source_id"),
            "observed_at",
            F.when(F.col("doc_id") % 7 != 0, F.col("observed_at")).alias("published_at"),
            _pick(CONTENT_TYPES, F.col("doc_id") % 10).alias("content_type"),
            "quality",
        )
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters of each document, numbered from 1 by line."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("item_id"), F.posexplode(F.split("text", "\n")).alias("line", "passage"))
    return lines.filter(F.length("passage") >= 40).select("item_id", (F.col("line") + 1).cast("long").alias("ordinal"), "passage")


#: phrasings that stand before a user's words, by conversation: the test tables hold no such questions.
#: Each with the type and the window that are expected of it
PHRASES = [
    ("今天发布了哪些模型", "recent_updates", "today"),
    ("昨天 what was released", "recent_updates", "yesterday"),
    ("上周 Alpha vs Beta", "comparison", "last_week"),
    ("请列出这周的时间线", "timeline", "this_week"),
    ("上个月价格是多少", "fact_check", "last_month"),
    ("which one this month 推荐", "recommendation", "this_month"),
    ("过去 3 周有什么变化", "explainer", "weeks"),
    ("last 10 days 参数是否公开", "fact_check", "days"),
    ("最近更新了什么", "recent_updates", "recent"),
    ("为什么稀疏模型更快", "explainer", None),
    ("本站收录了多少信源", "explainer", None),
    ("有哪些新动作", "recent_updates", "default"),
    ("how does routing work", "explainer", None),
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text, question, asked_at and what is expected: every user turn with a phrasing."""
    (talk,) = read_tables(spark, sf_dir, "conversations")
    phrases = spark.createDataFrame([(k, *p) for k, p in enumerate(PHRASES)], "phrase_no int, phrase string, expected_type string, expected_window string")
    asked = talk.filter("role = 'user'").withColumn("phrase_no", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(PHRASES))).cast("int"))
    at = F.lit(NOW).cast("timestamp") - F.make_interval(hours=F.pmod(F.col("conv_id") * 7, F.lit(2000)).cast("int"))
    return asked.join(F.broadcast(phrases), "phrase_no").select("conv_id", "turn", "text", F.concat_ws(" ", "phrase", "text").alias("question"), at.alias("asked_at"), "expected_type", "expected_window")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, answer: every assistant turn, a marker in its first sentence and two at its end."""
    (talk,) = read_tables(spark, sf_dir, "conversations")
    marked = F.regexp_replace("text", r"^([^.]*)\. ", "$1 [E2]. ")
    tail = F.concat(F.lit(" [E"), (F.col("turn") % 5 + 1).cast("string"), F.lit("] [E12]"))
    return talk.filter("role = 'assistant'").select("conv_id", "turn", F.concat(marked, tail).alias("answer"))


def _case(values: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_VALUES = ", ".join(f"({k}, '{a}', '{b}', {'NULL' if c is None else repr(c)})" for k, (a, b, c) in enumerate(PHRASES))
#: the questions and answers as CTEs
QUESTION_SQL = f"""phrase AS (SELECT * FROM (VALUES {_VALUES}) t(phrase_no, phrase, expected_type, expected_window)),
question AS (SELECT conv_id, turn, text, phrase || ' ' || text AS question, TIMESTAMP '{NOW}' - to_hours(CAST(conv_id * 7 % 2000 AS INTEGER)) AS asked_at, expected_type, expected_window
  FROM conversations JOIN phrase ON phrase_no = (conv_id + turn) % {len(PHRASES)} WHERE role = 'user')"""
ANSWER_SQL = "answer AS (SELECT conv_id, turn, regexp_replace(text, '^([^.]*)\\. ', '\\1 [E2]. ') || ' [E' || (turn % 5 + 1) || '] [E12]' AS answer FROM conversations WHERE role = 'assistant')"

#: CTEs for the SQL forms; a query starts with "WITH " + SQL + ", own AS (...)" or a SELECT
SQL = f"""source AS (SELECT source_id, n, {_case(TIERS, "n % 4")} AS tier, 'org' || CAST(n // 2 AS VARCHAR) AS organization
  FROM (SELECT DISTINCT source AS source_id, CAST(substr(source, 4, 10) AS INTEGER) AS n FROM documents)),
item AS (SELECT d.doc_id AS item_id, split_part(d.text, '.', 1) AS title, d.text AS body, d.source AS source_id, e.ts AS observed_at,
  CASE WHEN d.doc_id % 7 <> 0 THEN e.ts END AS published_at, {_case(CONTENT_TYPES, "d.doc_id % 10")} AS content_type,
  CAST(l.quality * 60 + 20 AS DOUBLE) AS quality
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
passage AS (SELECT item_id, CAST(ordinal AS BIGINT) AS ordinal, passage FROM (SELECT doc_id AS item_id, unnest(string_split(text, chr(10))) AS passage,
  generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents) WHERE length(passage) >= 40)"""
