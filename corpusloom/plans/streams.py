"""Batch twins of the stream operators, and functions called from SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import registered
from corpusloom.functions.text import CJK
from corpusloom.plans.ops import _K, failure_state, log
from corpusloom.plans.registry import query
from corpusloom.sources.tables import NOW, read_tables
from corpusloom.streaming import logs


@query("SELECT event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, event_id % 3 ORDER BY (event_id * 37) % 1009, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM events) WHERE mark IS NULL OR ts > mark")
def k1_stream_incremental(spark, sf_dir):
    """Rows newer than all that came before from their source (a caller's third), in a shuffled order of arrival."""
    k = F.col("event_id")
    arrival = W.partitionBy("user_id", k % 3).orderBy(k * 37 % 1009, "event_id").rowsBetween(W.unboundedPreceding, -1)
    return log(spark, sf_dir).withColumn("mark", F.max("ts").over(arrival)).filter("mark is null or ts > mark").select("event_id")


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS event_id FROM events GROUP BY ALL")
def k2_stream_dedupe(spark, sf_dir):
    """The first row of each caller, kind and day."""
    return log(spark, sf_dir).groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("event_id"))


@query(f"""WITH l AS (SELECT user_id, timezone('Asia/Shanghai', timezone('UTC', ts)) AS t, {_K} AS tokens FROM events) SELECT user_id, CAST(CAST(t AS DATE) AS VARCHAR) AS day, sum(tokens) AS tokens, sum(tokens) > 100 AS over_limit FROM l GROUP BY ALL""")
def k4_stream_spend(spark, sf_dir):
    """Tokens of each caller's local day against a limit."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai")).cast("string").alias("day")
    return log(spark, sf_dir).groupBy("user_id", day).agg(F.sum("tokens").alias("tokens"), (F.sum("tokens") > 100).alias("over_limit"))


def failures(spark, sf_dir):
    k = F.col("tokens") % 10
    return log(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "error").alias("failed"), F.when(k == 0, "RATE_LIMITED").otherwise("FETCH_FAILED").alias("code"), (k != 1).alias("retryable"))


@query(f"""WITH r AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, {_K} % 10 AS k, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER o AS island, min(ts) OVER (PARTITION BY user_id) AS born FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER i AS failures, coalesce(max(CASE WHEN NOT failed THEN ts END) OVER i, born) AS since FROM r WINDOW i AS (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, failures, CASE WHEN k = 0 THEN 'RATE_LIMITED' WHEN k = 1 THEN 'QUARANTINED' WHEN failures < 3 THEN 'ACTIVE' WHEN ts - since >= INTERVAL 24 HOUR THEN 'QUARANTINED' ELSE 'DEGRADED' END AS state FROM f WHERE failed""")
def k5_stream_health(spark, sf_dir):
    """The state of each source (caller) after each of its failures."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = failures(spark, sf_dir).withColumns({"island": F.count_if(~F.col("failed")).over(order), "born": F.min("ts").over(W.partitionBy("user_id"))})
    inside = W.partitionBy("user_id", "island").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"failures": F.count_if("failed").over(inside), "since": F.coalesce(F.max(F.when(~F.col("failed"), F.col("ts"))).over(inside), "born")}).filter("failed")
    return rows.select("user_id", "event_id", "failures", failure_state(F.col("failures"), F.col("code"), F.col("retryable"), F.col("since"), F.col("ts")).alias("state"))


@query(f"""WITH m AS (SELECT event_id, ts AS observed_at, CASE event_id % 5 WHEN 0 THEN ts + INTERVAL 400 DAY WHEN 1 THEN ts - INTERVAL 20000 DAY WHEN 2 THEN NULL ELSE ts - INTERVAL 1 HOUR END AS t FROM events)
SELECT event_id, strftime(CASE WHEN t <= TIMESTAMP '{NOW}' + INTERVAL 6 HOUR AND year(t) >= 1990 THEN t ELSE observed_at END, '%Y-%m-%d %H') AS hour FROM m""")
def k6_stream_late_guard(spark, sf_dir):
    """Times before the watermark sees them: implausible and missing ones give way to the observed ones."""
    k, ts = F.col("event_id") % 5, F.col("ts").cast("timestamp")
    moved = F.when(k == 0, ts + F.expr("INTERVAL 400 DAY")).when(k == 1, ts - F.expr("INTERVAL 20000 DAY")).when(k == 2, None).otherwise(ts - F.expr("INTERVAL 1 HOUR"))
    rows = log(spark, sf_dir).select("event_id", ts.alias("observed_at"), moved.alias("ts"))
    return logs.guarded(rows, NOW).select("event_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


@query("""WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS begin_at FROM events)
SELECT event_type, strftime(begin_at, '%Y-%m-%d %H') AS begin_at, count(*) AS calls, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM w GROUP BY ALL""")
def k8_stream_latency(spark, sf_dir):
    """Quantiles of each operation over windows of two hours that begin every hour."""
    found = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "2 hours", "1 hour"), "event_type")
    found = found.agg(F.count("*").alias("calls"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
    return found.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("begin_at"), "calls", "p50", "p95")


_WIDE = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '一丁七万丈三上下不与丐丑专且世丘丙业丛东丝丞丢两严并')"
_LEFT = f"length(regexp_replace(w, '{CJK}', '', 'g'))"


@query(f"""WITH t AS (SELECT doc_id, {_WIDE} AS w, lower(text) AS text FROM documents)
SELECT doc_id, CAST(CASE WHEN length(w) > 0 THEN greatest(floor((length(w) - {_LEFT}) / 1.5 + {_LEFT} / 4), 1) ELSE 0 END AS BIGINT) AS tokens, CAST(len(coalesce(list_distinct(flatten(list_transform(regexp_extract_all(w, '{CJK}{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda k: substr(r, k, 2))))), [])) AS BIGINT) AS pairs,
  CAST(len(list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS BIGINT) AS words FROM t""")
def l1_sql_functions(spark, sf_dir):
    """The registered functions called from SQL, over texts whose Latin letters are made CJK characters."""
    registered.register(spark)
    (docs,) = read_tables(spark, sf_dir, "documents")
    return spark.sql(f"SELECT doc_id, estimated_tokens({_WIDE}) AS tokens, CAST(size(cjk_bigrams({_WIDE})) AS BIGINT) AS pairs, CAST(size(search_tokens(text)) AS BIGINT) AS words FROM {{docs}}", docs=docs)


@query()
def l3_chunk_document(spark, sf_dir):
    """Passages by the table function."""
    registered.register(spark)
    (docs,) = read_tables(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, c.ordinal, c.tokens, sha2(c.passage, 256) AS passage_sha256, simhash64(c.passage) AS simhash FROM {docs} d, LATERAL chunk_document(d.text) c", docs=docs)
