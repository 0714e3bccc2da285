"""Usage, latency, health and cost over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.graph import Rounds
from corpusloom.operators.ranks import quantiles, values_at
from corpusloom.plans.reads import with_canonical
from corpusloom.plans.registry import query
from corpusloom.sources.tables import NOW, SQL, ZONE, items, read_tables, sources

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def log(spark, sf_dir):
    (events,) = read_tables(spark, sf_dir, "events")
    return events.withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


# Prices of a million tokens where a call has no snapshot of them (input, cached, output).
RATES = (2.0, 0.5, 8.0)
_USED = f"""used AS (SELECT event_id, event_type, 'm' || (user_id % 3) AS model, event_type = 'error' AS failed, value, 1 + event_id % 3 AS attempts, {_K} * 20 AS prompt, {_K} % 9 * 25 AS cached, user_id % 11 * 7 AS completion,
  CASE WHEN event_id % 4 > 0 THEN 1.5e0 END AS in_rate, CASE WHEN event_id % 4 > 1 THEN 0.3e0 END AS cached_rate, CASE WHEN event_id % 4 > 0 THEN 6e0 END AS out_rate FROM events),
priced AS (SELECT *, in_rate IS NOT NULL AND cached_rate IS NOT NULL AND out_rate IS NOT NULL AS snapshot FROM used)"""


def used(spark, sf_dir):
    """Calls with tokens and, for some, a snapshot of prices, which counts where it is complete."""
    k, n = F.col("tokens"), F.col("event_id") % 4
    rows = log(spark, sf_dir).select(
        "event_id", "event_type", F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), (F.col("event_type") == "error").alias("failed"), "value", (F.col("event_id") % 3 + 1).alias("attempts"),
        (k * 20).alias("prompt"), (k % 9 * 25).alias("cached"), (F.col("user_id") % 11 * 7).alias("completion"), F.when(n > 0, 1.5).alias("in_rate"), F.when(n > 1, 0.3).alias("cached_rate"), F.when(n > 0, 6.0).alias("out_rate"),
    )
    return rows.withColumn("snapshot", F.col("in_rate").isNotNull() & F.col("cached_rate").isNotNull() & F.col("out_rate").isNotNull())


@query(f"""WITH {_USED} SELECT event_type AS operation, model, count(*) AS calls, sum(prompt) AS prompt, sum(cached) AS cached, sum(completion) AS completion, count(*) FILTER (WHERE failed) AS failed, round(avg(value), 6) AS avg_latency,
  round(sum(greatest(prompt - cached, 0) * CASE WHEN snapshot THEN in_rate ELSE {RATES[0]} END + cached * CASE WHEN snapshot THEN cached_rate ELSE {RATES[1]} END + completion * CASE WHEN snapshot THEN out_rate ELSE {RATES[2]} END) / 1e6, 6) AS cost,
  round(count(*) FILTER (WHERE snapshot) / count(*), 6) AS snapshot_share FROM priced GROUP BY event_type, model""")
def d10_usage_cost(spark, sf_dir):
    rate = lambda name, k: F.when(F.col("snapshot"), F.col(name)).otherwise(F.lit(RATES[k]))
    cost = F.greatest(F.col("prompt") - F.col("cached"), F.lit(0)) * rate("in_rate", 0) + F.col("cached") * rate("cached_rate", 1) + F.col("completion") * rate("out_rate", 2)
    return used(spark, sf_dir).groupBy(F.col("event_type").alias("operation"), "model").agg(
        F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("prompt", "cached", "completion")], F.count_if("failed").alias("failed"), F.round(F.avg("value"), 6).alias("avg_latency"),
        F.round(F.sum(cost) / 1e6, 6).alias("cost"), F.round(F.count_if("snapshot") / F.count("*"), 6).alias("snapshot_share"),
    )


@query(f"WITH {_USED} SELECT model, count(*) AS calls, sum(prompt + completion) AS tokens, sum(attempts) AS attempts, count(*) FILTER (WHERE failed) AS failed, round(avg(value), 6) AS avg_latency FROM priced GROUP BY model")
def d11_usage_by_model(spark, sf_dir):
    return used(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum("attempts").alias("attempts"), F.count_if("failed").alias("failed"), F.round(F.avg("value"), 6).alias("avg_latency")
    )


def staged(spark, sf_dir):
    """Each call's time in whole and by stage, from a JSON map as a trace stores it."""
    rows = log(spark, sf_dir).select("event_id", "event_type", "value", F.to_json(F.create_map(F.lit("retrieve"), F.col("value") * (F.col("tokens") % 50 + 1) / 100, F.lit("rerank"), F.col("value") * 0.25)).alias("stages"))
    found = F.explode(F.map_concat(F.create_map(F.lit("total"), F.col("value")), F.from_json("stages", "map<string, double>"))).alias("stage", "ms")
    return rows.select("event_id", "event_type", found, "value").select("event_id", "event_type", "stage", "ms", F.when(F.col("value") > 0, F.col("ms") / F.col("value")).alias("share"))


_STAGED = f"""staged AS (SELECT event_id, event_type, unnest(['total', 'retrieve', 'rerank']) AS stage, unnest([value, value * ({_K} % 50 + 1) / 100, value * 0.25e0]) AS ms, value FROM events)"""


@query(f"""WITH {_STAGED} SELECT event_type, stage, count(*) AS calls, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99, round(max(ms), 5) AS worst, round(quantile_cont(ms / value, 0.5) FILTER (WHERE value > 0), 5) AS median_share,
  CASE WHEN stage = 'total' THEN CASE WHEN count(*) < 20 THEN 'TOO_FEW' WHEN quantile_cont(ms, 0.95) > 100 THEN 'BREACHED' ELSE 'MET' END END AS slo FROM staged GROUP BY event_type, stage""")
def d12_latency_summary(spark, sf_dir):
    """Quantiles of times and shares by operation and stage; whether the objective is met, from twenty calls on."""
    keys = ["event_type", "stage"]
    both = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("amount")) for c in ("ms", "share")]))
    rows = Rounds(spark, "latency").save(staged(spark, sf_dir).select(*keys, both), "amounts")  # traces are parsed once
    told = quantiles(rows, [*keys, "kind"], "amount", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    shares = told.filter("kind = 'share'").select(*keys, F.col("p50").alias("median_share"))
    found = told.filter("kind = 'ms'").select(*keys, F.col("rows").alias("calls"), F.round("most", 5).alias("worst"), "p50", "p95", "p99").join(shares, keys)
    slo = F.when(F.col("stage") != "total", None).when(F.col("calls") < 20, "TOO_FEW").when(F.col("p95") > 100, "BREACHED").otherwise("MET")
    return found.select(*keys, "calls", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")], "worst", F.round("median_share", 5).alias("median_share"), slo.alias("slo"))


@query(f"""WITH {_STAGED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, stage ORDER BY ms, event_id) AS r, count(*) OVER (PARTITION BY event_type, stage) AS n FROM staged),
m AS (SELECT event_type, avg(ms) AS whole FROM staged WHERE stage = 'total' GROUP BY 1)
SELECT event_type, stage, round(max(ms) FILTER (WHERE r = greatest(1, CAST(round_even(0.95 * n, 0) AS BIGINT))), 4) AS p95, round(avg(ms) / max(whole), 5) AS stage_share FROM r JOIN m USING (event_type) GROUP BY event_type, stage""")
def d14_nearest_rank_latency(spark, sf_dir):
    """The nearest-rank quantile of each stage, and its mean as a part of the whole's."""
    keys = ["event_type", "stage"]
    rows = Rounds(spark, "latency").save(staged(spark, sf_dir).select(*keys, "ms"), "times")
    means = rows.groupBy(*keys).agg(F.avg("ms").alias("mean"))
    means = means.join(means.filter("stage = 'total'").select("event_type", F.col("mean").alias("whole")), "event_type")
    found, _ = values_at(rows, keys, "ms", lambda n: [F.greatest(F.lit(1), F.bround(F.lit(0.95) * n, 0).cast("long"))])
    placed = found.join(means, keys)
    return placed.select(*keys, F.round("value", 5).alias("p95"), F.round(F.col("mean") / F.col("whole"), 5).alias("stage_share"))


@query(f"""WITH {SQL}, runs AS (SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS ok, strftime(max(ts), '%Y-%m-%d %H') AS last_run FROM events WHERE user_id % 4 > 0 GROUP BY user_id),
have AS (SELECT source_id, count(*) AS items, count(quality) AS labelled FROM item GROUP BY source_id)
SELECT s.source_id, coalesce(items, 0) AS items, coalesce(labelled, 0) AS labelled, coalesce(runs, 0) AS runs, CASE WHEN runs > 0 THEN round(ok * 1000.0 / runs) / 10 END AS acceptance, last_run,
  CASE WHEN runs IS NULL THEN 4 WHEN ok = 0 THEN 3 WHEN ok * 2 < runs THEN 2 ELSE 1 END AS state_rank FROM source s LEFT JOIN runs ON user_id = n LEFT JOIN have USING (source_id)""")
def d7_source_health(spark, sf_dir):
    """Every source with its runs (of the caller with its number) and its items, each summed before they are joined."""
    runs = log(spark, sf_dir).filter("user_id % 4 > 0").groupBy(F.col("user_id").alias("n")).agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") != "error").alias("ok"), F.date_format(F.max("ts"), "yyyy-MM-dd HH").alias("last_run"))
    have = items(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("items"), F.count("quality").alias("labelled"))
    rows = sources(spark, sf_dir).join(runs, "n", "left").join(have, "source_id", "left")
    rank = F.when(F.col("runs").isNull(), 4).when(F.col("ok") == 0, 3).when(F.col("ok") * 2 < F.col("runs"), 2).otherwise(1)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source_id", zero("items"), zero("labelled"), zero("runs"), F.when(F.col("runs") > 0, F.round(F.col("ok") * 1000.0 / F.col("runs")) / 10).alias("acceptance"), "last_run", rank.alias("state_rank"))


@query(f"""WITH {SQL}, f AS (SELECT *, min(item_id) OVER (PARTITION BY body) < item_id AS is_copy FROM item), e AS (SELECT f.*, event_type, value FROM f JOIN events ON event_id = item_id)
SELECT source_id, strftime(observed_at, '%Y-%m-%d') AS day, count(*) AS found, round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0 END), 6) AS discovery_rate, round(avg(CASE WHEN length(trim(body)) > 0 THEN 1e0 ELSE 0 END), 6) AS fetch_rate, round(avg(CASE WHEN length(body) >= 300 THEN 1e0 ELSE 0 END), 6) AS parse_rate,
  round(median(length(body)), 3) AS median_chars, round(quantile_cont(value, 0.95), 6) AS p95_lag, round(avg(CASE WHEN is_copy THEN 1e0 ELSE 0 END), 6) AS copy_rate FROM e GROUP BY ALL""")
def d9_source_health_daily(spark, sf_dir):
    """Each source's day: rates of discovery, fetching and parsing, median size, lag (here an event's value), copies."""
    (events,) = read_tables(spark, sf_dir, "events")
    rows = with_canonical(items(spark, sf_dir)).join(events.select(F.col("event_id").alias("item_id"), "event_type", "value"), "item_id")
    rate = lambda hit: F.round(F.avg(hit.cast("double")), 6)
    size = F.length("body")
    keys = ["source_id", "day"]
    rows = rows.withColumns({"day": F.date_format("observed_at", "yyyy-MM-dd"), "chars": size})
    known = rows.select(*keys, "event_type", (F.length(F.trim("body")) > 0).alias("fetched"), "chars", "value", (F.col("canonical_id") < F.col("item_id")).alias("is_copy"))
    rows = Rounds(spark, "health").save(known, "known")
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("found"), rate(F.col("event_type") != "error").alias("discovery_rate"), rate(F.col("fetched")).alias("fetch_rate"), rate(F.col("chars") >= 300).alias("parse_rate"), rate(F.col("is_copy")).alias("copy_rate"),
    )
    sizes = quantiles(rows, keys, "chars", {"median_chars": 0.5}).select(*keys, "median_chars")
    lags = quantiles(rows, keys, "value", {"p95_lag": 0.95}).select(*keys, "p95_lag")
    both = found.join(sizes, keys, "left").join(lags, keys, "left")
    return both.withColumns({"median_chars": F.round("median_chars", 3), "p95_lag": F.round("p95_lag", 6)})


@query(f"SELECT day, tokens, tokens > ceiling AND ceiling > 0 AS over_limit FROM (SELECT CAST(CAST(timezone('{ZONE}', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS day, sum({_K}) AS tokens, CASE WHEN day(CAST(timezone('{ZONE}', timezone('UTC', ts)) AS DATE)) % 3 > 0 THEN 15000 ELSE 0 END AS ceiling FROM events GROUP BY ALL)")
def d25_daily_token_spend(spark, sf_dir):
    """Tokens of each local day against its ceiling (here none on every third day: a ceiling of 0 forbids nothing)."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE))
    spent = log(spark, sf_dir).groupBy(day.alias("d")).agg(F.sum("tokens").alias("tokens"))
    ceiling = F.when(F.day("d") % 3 > 0, 15000).otherwise(0)
    return spent.select(F.col("d").cast("string").alias("day"), "tokens", ((F.col("tokens") > ceiling) & (ceiling > 0)).alias("over_limit"))


@query(f"""WITH r AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed, CASE WHEN {_K} % 10 = 0 THEN 'RATE_LIMITED' ELSE 'FETCH_FAILED' END AS code, {_K} % 10 <> 1 AS retryable, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
k AS (SELECT user_id, max(island) AS island FROM r GROUP BY user_id), f AS (SELECT r.user_id, count(*) FILTER (WHERE failed) AS failures, max_by(code, (ts, event_id)) FILTER (WHERE failed) AS code, max_by(retryable, (ts, event_id)) FILTER (WHERE failed) AS retryable, max(ts) FILTER (WHERE NOT failed) AS last_ok, min(ts) AS since FROM r JOIN k USING (user_id, island) GROUP BY r.user_id)
SELECT user_id, failures, CASE WHEN failures = 0 THEN 'ACTIVE' WHEN code = 'RATE_LIMITED' THEN 'RATE_LIMITED' WHEN NOT retryable THEN 'QUARANTINED' WHEN failures < 3 THEN 'ACTIVE' WHEN TIMESTAMP '{NOW}' - coalesce(last_ok, since) >= INTERVAL 24 HOUR THEN 'QUARANTINED' ELSE 'DEGRADED' END AS state FROM f""")
def e14_consecutive_failures(spark, sf_dir):
    """The run of failures since each caller's last success, and the state that follows from it and from the last
    failure's kind: two sums by key, as the last success splits the log."""
    k = F.col("tokens") % 10
    rows = log(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), "ts", (F.col("event_type") == "error").alias("failed"), F.when(k == 0, "RATE_LIMITED").otherwise("FETCH_FAILED").alias("code"), (k != 1).alias("retryable"))
    last = rows.groupBy("user_id").agg(F.max(F.when(~F.col("failed"), F.col("at"))).alias("last_ok"), F.min("ts").alias("since"))
    tail = rows.filter("failed").join(last, "user_id").filter(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok")))
    counts = tail.groupBy("user_id").agg(F.count("*").alias("failures"), F.max_by(F.struct("code", "retryable"), "at").alias("why"))
    found = last.join(counts, "user_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    return found.select("user_id", "failures", failure_state(F.col("failures"), F.col("why.code"), F.col("why.retryable"), F.coalesce("last_ok.ts", "since"), F.lit(NOW)).alias("state"))


def failure_state(failures, code, retryable, since, now):
    """A source's state by its failures since the last success (``since``)."""
    old = now.cast("timestamp") - since.cast("timestamp") >= F.expr("INTERVAL 24 HOUR")
    return F.when(failures == 0, "ACTIVE").when(code == "RATE_LIMITED", "RATE_LIMITED").when(~retryable, "QUARANTINED").when(failures < 3, "ACTIVE").when(old, "QUARANTINED").otherwise("DEGRADED")


@query("""SELECT user_id, 'minute' AS span, strftime(ts, '%Y-%m-%d %H:%M') AS begin_at, count(*) AS calls, count(*) > 3 AS over_quota FROM events GROUP BY ALL
  UNION ALL SELECT user_id, 'day', strftime(ts, '%Y-%m-%d'), count(*), count(*) > 20 FROM events GROUP BY ALL""")
def k3_quota_per_minute(spark, sf_dir):
    """Calls of each caller in fixed minutes and days, and those over three and twenty."""
    spans = F.explode(F.array(*[F.struct(F.lit(s).alias("span"), F.date_format("ts", f).alias("begin_at"), F.lit(n).alias("most")) for s, f, n in (("minute", "yyyy-MM-dd HH:mm", 3), ("day", "yyyy-MM-dd", 20))])).alias("s")
    rows = log(spark, sf_dir).select("user_id", spans).groupBy("user_id", "s.span", "s.begin_at", "s.most").agg(F.count("*").alias("calls"))
    return rows.select("user_id", "span", "begin_at", "calls", (F.col("calls") > F.col("most")).alias("over_quota"))


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def k7_retention(spark, sf_dir):
    return log(spark, sf_dir).filter(F.col("ts").cast("timestamp") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 14 DAY")).select("event_id")


@query("SELECT round(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) / count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')), 6) AS hit_rate, count(*) FILTER (WHERE event_type IN ('click', 'purchase', 'view')) AS lookups, round(count(*) FILTER (WHERE event_type = 'signup' AND value > 50) / count(*) FILTER (WHERE event_type = 'signup'), 6) AS embedding_rate FROM events")
def d23_cache_hit_rate(spark, sf_dir):
    """Exact and semantic hits among lookups (binding: clicks, purchases, views), and hits of the embeddings' cache (sign-ups)."""
    kind = F.col("event_type")
    hits, lookups, own = kind.isin("click", "purchase"), kind.isin("click", "purchase", "view"), kind == "signup"
    return log(spark, sf_dir).agg(
        F.round(F.count_if(hits) / F.count_if(lookups), 6).alias("hit_rate"), F.count_if(lookups).alias("lookups"), F.round(F.count_if(own & (F.col("value") > 50)) / F.count_if(own), 6).alias("embedding_rate")
    )
