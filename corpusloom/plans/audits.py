"""Freshness of judgments, reviews of labels, their intervals and history, and who is due which report."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.ranks import ranked
from corpusloom.plans.evaluation import _JUDGED, judgments
from corpusloom.plans.registry import query
from corpusloom.sources.tables import NOW, SQL, ZONE, items, read_tables

ANNOTATED, GROWTH = "2024-01-02 00:00:00", 0.25


@query(f"""WITH {SQL}, {_JUDGED}, g AS (SELECT query_id, doc_id + CASE WHEN doc_id % 9 = 0 THEN 1000000000 ELSE 0 END AS doc_id FROM judged), s AS (SELECT g.*, i.item_id IS NULL AS missing, i.item_id IS NOT NULL AND e.vec_id IS NULL AS unretrievable FROM g LEFT JOIN item i ON i.item_id = g.doc_id LEFT JOIN embeddings e ON e.vec_id = g.doc_id),
n AS (SELECT count(*) AS now, count(*) FILTER (WHERE coalesce(published_at, observed_at) > TIMESTAMP '{ANNOTATED}') AS arrived FROM item)
SELECT count(DISTINCT doc_id) AS annotated, count(DISTINCT doc_id) FILTER (WHERE missing) AS missing, count(DISTINCT doc_id) FILTER (WHERE unretrievable) AS unretrievable, count(DISTINCT query_id) FILTER (WHERE missing OR unretrievable) AS affected, round(max(arrived) / greatest(max(now) - max(arrived), 1), 4) AS growth,
  coalesce(bool_or(missing OR unretrievable), false) OR max(arrived) / greatest(max(now) - max(arrived), 1) > {GROWTH} AS review FROM s, n""")
def c11_golden_freshness(spark, sf_dir):
    """Judged documents that are gone (here: every ninth) or without a vector, the questions that touches, and how the corpus has grown."""
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    rows = items(spark, sf_dir)
    gold = judgments(spark, sf_dir).select("query_id", (F.col("doc_id") + F.when(F.col("doc_id") % 9 == 0, 1_000_000_000).otherwise(0)).alias("doc_id"))
    known = rows.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("known"))
    have = vectors.select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    gold = gold.join(known, "doc_id", "left").join(have, "doc_id", "left")
    missing, lost = F.col("known").isNull(), F.col("known").isNotNull() & F.col("embedded").isNull()
    sums = gold.agg(
        F.countDistinct("doc_id").alias("annotated"), F.countDistinct(F.when(missing, F.col("doc_id"))).alias("missing"), F.countDistinct(F.when(lost, F.col("doc_id"))).alias("unretrievable"), F.countDistinct(F.when(missing | lost, F.col("query_id"))).alias("affected")
    )
    late = F.coalesce("published_at", "observed_at") > F.lit(ANNOTATED)
    size = rows.agg(F.count("*").alias("now"), F.count_if(late).alias("arrived"))
    growth = F.col("arrived") / F.greatest(F.col("now") - F.col("arrived"), F.lit(1))
    both = sums.crossJoin(size)  # one row each
    return both.select("annotated", "missing", "unretrievable", "affected", F.round(growth, 4).alias("growth"), ((F.col("missing") + F.col("unretrievable") > 0) | (growth > GROWTH)).alias("review"))


_ZONES = ["Asia/Shanghai", "Europe/Berlin", "America/New_York"]
_DUE = f"""sub AS (SELECT c_custkey AS subscription_id, {"CASE c_custkey % 3 " + " ".join(f"WHEN {k} THEN '{z}'" for k, z in enumerate(_ZONES)) + " END"} AS zone, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS confirmed_at, lpad(CAST(c_custkey % 24 AS VARCHAR), 2, '0') || ':00' AS delivery_at, c_custkey % 7 > 0 AS active FROM customer),
pref AS (SELECT subscription_id, unnest(CASE WHEN subscription_id % 2 = 0 THEN ['daily', 'weekly'] ELSE ['daily'] END) AS period FROM sub),
rep AS (SELECT 'daily' AS period, strftime(d, '%Y-%m-%d') AS key, d + INTERVAL 22 HOUR AS published_at, day(d) % 5 > 0 AS published FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events) UNION ALL SELECT DISTINCT 'weekly', isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0'), date_trunc('week', d) + INTERVAL 7 DAY, true FROM (SELECT DISTINCT date_trunc('day', ts) AS d FROM events))"""


@query(f"""WITH {_DUE}, latest AS (SELECT s.subscription_id, r.period, max(r.key) AS key FROM sub s JOIN pref p USING (subscription_id) JOIN rep r ON r.period = p.period AND r.published AND r.published_at >= s.confirmed_at
  WHERE s.active AND strftime(timezone(s.zone, timezone('UTC', TIMESTAMP '{NOW}')), '%H:%M') >= s.delivery_at GROUP BY ALL) SELECT * FROM latest WHERE NOT (subscription_id % 4 = 1 AND period = 'daily')""")
def c7_latest_published_per_subscriber(spark, sf_dir):
    """The newest published report of each subscriber (a customer) and period since they confirmed, once their local time of
    delivery has come, unless it was sent already (here: the daily one to every fourth)."""
    people, events = read_tables(spark, sf_dir, "customer", "events")
    k = F.col("c_custkey")
    zone = F.element_at(F.array(*[F.lit(z) for z in _ZONES]), (k % 3 + 1).cast("int"))
    confirmed = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(k % 40).cast("int"))
    subs = people.filter(k % 7 > 0).select(k.alias("subscription_id"), zone.alias("zone"), confirmed.alias("confirmed_at"), F.format_string("%02d:00", k % 24).alias("delivery_at"), F.explode(F.when(k % 2 == 0, F.array(F.lit("daily"), F.lit("weekly"))).otherwise(F.array(F.lit("daily")))).alias("period"))
    due = subs.filter(F.date_format(F.from_utc_timestamp(F.lit(NOW).cast("timestamp"), F.col("zone")), "HH:mm") >= F.col("delivery_at"))
    days = events.select(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d")).distinct()
    daily = days.filter(F.day("d") % 5 > 0).select(F.lit("daily").alias("period"), F.date_format("d", "yyyy-MM-dd").alias("key"), (F.col("d") + F.expr("INTERVAL 22 HOUR")).alias("published_at"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("d")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    weekly = days.select(F.lit("weekly").alias("period"), week.alias("key"), (F.date_trunc("week", "d") + F.expr("INTERVAL 7 DAY")).alias("published_at")).distinct()
    # a report a day and week: keys rise with the time of publication, so only the newest of a period can be a subscriber's
    newest = daily.union(weekly).groupBy("period").agg(F.max(F.struct("key", "published_at")).alias("r")).select("period", "r.*")
    latest = due.join(newest, "period").filter(F.col("published_at") >= F.col("confirmed_at")).select("subscription_id", "period", "key")
    sent = people.filter(k % 4 == 1).select(k.alias("subscription_id"), F.lit("daily").alias("period"))
    return latest.join(sent, ["subscription_id", "period"], "left_anti")


# ---- reviews of labels

_SAMPLE = "p AS (SELECT d.doc_id, lang, n_chars > 800 AS predicted, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)), sampled AS (SELECT * FROM p WHERE quality IS NOT NULL OR (lang = 'fr' AND doc_id % 50 = 7)), size AS (SELECT lang, predicted, count(*) AS population FROM p GROUP BY ALL)"


def sampled(spark, sf_dir):
    """Reviewed documents by language and predicted class, with how many there are; in French some wait for their review."""
    docs, labels = read_tables(spark, sf_dir, "documents", "labels")
    rows = docs.select("doc_id", "lang", (F.col("n_chars") > 800).alias("predicted")).join(labels.select("doc_id", "quality"), "doc_id", "left")
    size = rows.groupBy("lang", "predicted").agg(F.count("*").alias("population"))
    kept = rows.filter(F.col("quality").isNotNull() | ((F.col("lang") == "fr") & (F.col("doc_id") % 50 == 7)))
    return kept.join(F.broadcast(size), ["lang", "predicted"])  # a row a stratum


@query(f"""WITH {_SAMPLE}, c AS (SELECT s.lang, s.predicted, max(population) AS population, count(quality) AS reviewed, count(*) AS taken, count(*) FILTER (WHERE quality = 1) AS good FROM sampled s JOIN size USING (lang, predicted) GROUP BY ALL),
w AS (SELECT lang, sum(taken) AS taken, sum(reviewed) AS reviewed, sum(CASE WHEN predicted THEN good * population / reviewed ELSE 0 END) AS tp, sum(CASE WHEN predicted THEN (reviewed - good) * population / reviewed ELSE 0 END) AS fp, sum(CASE WHEN NOT predicted THEN good * population / reviewed ELSE 0 END) AS fn, sum(CASE WHEN NOT predicted THEN (reviewed - good) * population / reviewed ELSE 0 END) AS tn FROM c WHERE reviewed > 0 GROUP BY lang)
SELECT lang, round(reviewed / taken, 6) AS coverage, round(CASE WHEN reviewed = taken THEN tp END, 4) AS tp, round(CASE WHEN reviewed = taken THEN fp END, 4) AS fp, round(CASE WHEN reviewed = taken THEN fn END, 4) AS fn, round(CASE WHEN reviewed = taken THEN tn END, 4) AS tn,
  round(CASE WHEN reviewed = taken AND tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN reviewed = taken AND tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM w""")
def j12_relation_metrics(spark, sf_dir):
    """Estimated hits and misses of each language from its strata, each reviewed row weighted by its stratum's size; no
    score while a review is pending."""
    cells = sampled(spark, sf_dir).groupBy("lang", "predicted").agg(F.max("population").alias("population"), F.count("quality").alias("reviewed"), F.count("*").alias("taken"), F.count_if(F.col("quality") == 1).alias("good")).filter("reviewed > 0")
    weight = F.col("population") / F.col("reviewed")
    part = lambda p, n: F.sum(F.when(p, n * weight).otherwise(0.0))
    yes, bad = F.col("predicted"), F.col("reviewed") - F.col("good")
    sums = cells.groupBy("lang").agg(F.sum("taken").alias("taken"), F.sum("reviewed").alias("reviewed"), part(yes, F.col("good")).alias("tp"), part(yes, bad).alias("fp"), part(~yes, F.col("good")).alias("fn"), part(~yes, bad).alias("tn"))
    done = F.col("reviewed") == F.col("taken")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "lang", F.round(F.col("reviewed") / F.col("taken"), 6).alias("coverage"), *[F.round(F.when(done, F.col(c)), 4).alias(c) for c in ("tp", "fp", "fn", "tn")],
        F.round(F.when(done & (tp + fp > 0), tp / (tp + fp)), 6).alias("precision"), F.round(F.when(done & (tp + fn > 0), tp / (tp + fn)), 6).alias("recall"),
    )


DRAWS = 1000


def poisson_counts(rows, draws: int = DRAWS, seed: int = 1):
    """lang, predicted, quality, draw, times, n of rows (lang, predicted, quality, doc_id): how often each kind of row is drawn, and how many rows it has.

    Each row draws for itself how often it is in every resample (a Poisson number, as in a large resample),
    by a generator seeded with its id; a task sums these numbers by kind, so a row is read once and never copied.
    """

    def run(batches):
        sums, sizes = {}, Counter()
        for batch in batches:
            for *kind, doc_id in zip(*[c.to_pylist() for c in batch.columns]):
                drawn = np.random.Generator(np.random.Philox(key=[seed, doc_id & (1 << 64) - 1])).poisson(1.0, draws)
                sums[tuple(kind)] = sums.get(tuple(kind), 0) + drawn
                sizes[tuple(kind)] += 1
        kinds = [*zip(*sums)] or [(), (), ()]
        types = (pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(kinds, types)], pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64())), pa.array([sizes[k] for k in sums], pa.int64())], names=["lang", "predicted", "quality", "drawn", "n"])

    rows = rows.select("lang", "predicted", F.col("quality").cast("long").alias("quality"), F.col("doc_id").cast("long").alias("doc_id"))
    found = rows.mapInArrow(run, "lang string, predicted boolean, quality long, drawn array<long>, n long")
    return found.select("lang", "predicted", "quality", "n", F.posexplode("drawn").alias("draw", "times")).groupBy("lang", "predicted", "quality", "draw").agg(F.sum("times").alias("times"), F.sum("n").alias("n"))


@query()
def j13_bootstrap_ci(spark, sf_dir):
    """The middle 95 % of precision and recall over a thousand resamples of each language's reviewed rows, weighted
    within their strata."""
    rows = sampled(spark, sf_dir).filter("quality is not null")
    strata = rows.groupBy("lang", "predicted").agg(F.max("population").alias("population"))
    counts = poisson_counts(rows.select("lang", "predicted", "quality", "doc_id"))
    # a small stratum of which nothing was drawn counts as it is
    drawn, every = (F.sum(c).over(W.partitionBy("lang", "predicted", "draw")) for c in ("times", "n"))
    told = counts.join(strata, ["lang", "predicted"]).withColumns({"share": F.col("population") / F.when(drawn > 0, drawn).otherwise(every), "times": F.when(drawn > 0, F.col("times")).otherwise(F.col("n"))})
    part = lambda p, q: F.sum(F.when(p & (F.col("quality") == q), F.col("times") * F.col("share")).otherwise(0.0))
    yes = F.col("predicted")
    told = told.groupBy("lang", "draw").agg(part(yes, 1).alias("tp"), part(yes, 0).alias("fp"), part(~yes, 1).alias("fn"))
    told = told.select("lang", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"))
    ends = [F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{name}") for c in ("precision", "recall") for name, q in (("low", 0.025), ("high", 0.975))]
    return told.groupBy("lang").agg(*ends)


_TWO = "two AS (SELECT doc_id, quality AS first, 1 - toxic AS second FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(f"""WITH {_TWO}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE first = second) AS same, count(*) FILTER (WHERE first = 1) AS a, count(*) FILTER (WHERE second = 1) AS b FROM two), k AS (SELECT n, same / n AS po, (a / n) * (b / n) + (1 - a / n) * (1 - b / n) AS pe FROM c)
SELECT NULL AS doc_id, n, round(po, 6) AS agreement, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) END AS kappa FROM k UNION ALL SELECT doc_id, NULL, NULL, NULL FROM two WHERE first <> second""")
def j14_reviewer_agreement(spark, sf_dir):
    """One row with agreement and kappa of two reviews (here: quality, and not toxic), and a row for each disagreement."""
    (labels,) = read_tables(spark, sf_dir, "labels")
    two = labels.filter("quality is not null and toxic is not null").select("doc_id", F.col("quality").alias("first"), (1 - F.col("toxic")).alias("second"))
    n = F.count("*")
    counts = two.agg(n.alias("n"), (F.count_if(F.col("first") == F.col("second")) / n).alias("po"), (F.count_if(F.col("first") == 1) / n).alias("a"), (F.count_if(F.col("second") == 1) / n).alias("b"))
    counts = counts.withColumn("pe", F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b")))
    told = counts.select(F.lit(None).cast("long").alias("doc_id"), "n", F.round("po", 6).alias("agreement"), F.when(F.col("pe") < 1, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).alias("kappa"))
    none = F.lit(None)
    return told.unionByName(two.filter("first <> second").select("doc_id", none.cast("long").alias("n"), none.cast("double").alias("agreement"), none.cast("double").alias("kappa")))


@query(f"""WITH {_TWO}, r AS (SELECT two.*, CASE WHEN doc_id % 5 > 0 THEN doc_id % 2 END AS ruling, TIMESTAMP '2024-01-05' + to_hours(CAST(doc_id % 50 AS INTEGER)) AS at_first, TIMESTAMP '2024-01-06' + to_hours(CAST(doc_id % 30 AS INTEGER)) AS at_second, TIMESTAMP '2024-01-09' AS at_ruling FROM two)
SELECT doc_id, CASE WHEN first = second THEN first ELSE ruling END AS label, CASE WHEN first = second THEN 'agreed' WHEN ruling IS NULL THEN 'missing' ELSE 'adjudicated' END AS kind, strftime(CASE WHEN first = second OR ruling IS NULL THEN greatest(at_first, at_second) ELSE greatest(at_first, at_second, at_ruling) END, '%Y-%m-%d %H') AS reviewed_at FROM r""")
def j15_finalize_labels(spark, sf_dir):
    """The label that both reviews give, else the ruling (here: none for every fifth, which is a violation), and when it was last looked at."""
    (labels,) = read_tables(spark, sf_dir, "labels")
    k = F.col("doc_id")
    hours = lambda day, n: F.lit(day).cast("timestamp") + F.make_interval(hours=(k % n).cast("int"))
    two = labels.filter("quality is not null and toxic is not null").select("doc_id", F.col("quality").alias("first"), (1 - F.col("toxic")).alias("second"))
    rulings = labels.filter(k % 5 > 0).select("doc_id", (k % 2).alias("ruling"), F.lit("2024-01-09").cast("timestamp").alias("at_ruling"))
    rows = two.join(rulings, "doc_id", "left").withColumn("at", F.greatest(hours("2024-01-05", 50), hours("2024-01-06", 30)))
    same, open_ = F.col("first") == F.col("second"), F.col("ruling").isNull()
    return rows.select(
        "doc_id", F.when(same, F.col("first")).otherwise(F.col("ruling")).alias("label"), F.when(same, "agreed").when(open_, "missing").otherwise("adjudicated").alias("kind"),
        F.date_format(F.when(same | open_, F.col("at")).otherwise(F.greatest("at", "at_ruling")), "yyyy-MM-dd HH").alias("reviewed_at"),
    )


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('packet:' || doc_id), doc_id) AS place, doc_id % 23 = 0 OR doc_id % 29 = 0 AS tampered FROM documents JOIN labels USING (doc_id)""")
def j16_blind_packet(spark, sf_dir):
    """Reviewed documents of each language in an order that a seed gives, and whether a protected field of the packet that
    comes back (here: some are changed) differs from what was sent."""
    docs, labels = read_tables(spark, sf_dir, "documents", "labels")
    key = F.md5(F.concat(F.lit("packet:"), F.col("doc_id").cast("string")))
    sent = docs.select("doc_id", "lang", "source", "n_chars", key.alias("key")).join(labels.select("doc_id"), "doc_id")
    placed = ranked(sent, ["lang"], ["key", "doc_id"], "place")
    k = F.col("doc_id")
    back = sent.select("doc_id", F.when(k % 23 == 0, "src?").otherwise(F.col("source")).alias("back_source"), (F.col("n_chars") + F.when(k % 29 == 0, 1).otherwise(0)).alias("back_chars"))
    rows = placed.join(back, "doc_id")
    return rows.select("doc_id", "place", ((F.col("source") != F.col("back_source")) | (F.col("n_chars") != F.col("back_chars"))).alias("tampered"))


@query(f"""WITH r AS (SELECT CAST(CAST(timezone('{ZONE}', timezone('UTC', ts)) AS DATE) AS VARCHAR) AS round, round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0 END), 4) AS recall, round(avg(value), 4) AS latency FROM events GROUP BY 1)
SELECT round, recall, latency, round(recall - lag(recall) OVER o, 4) AS recall_delta, round(latency - lag(latency) OVER o, 4) AS latency_delta FROM r WINDOW o AS (ORDER BY round)""")
def j19_eval_history(spark, sf_dir):
    """Metrics of each round (here: a day of the log) and how they differ from the round before."""
    (events,) = read_tables(spark, sf_dir, "events")
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE)).cast("string").alias("round")
    rounds = events.groupBy(day).agg(F.round(F.avg((F.col("event_type") != "error").cast("double")), 4).alias("recall"), F.round(F.avg("value"), 4).alias("latency"))
    order = W.orderBy("round")  # as many rows as rounds
    delta = lambda c: F.round(F.col(c) - F.lag(c).over(order), 4).alias(f"{c}_delta")
    return rounds.select("round", "recall", "latency", delta("recall"), delta("latency"))
