"""Queries of heat, daily selection and report products."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.plans.registry import query
from corpusloom.sources.tables import NOW, SQL, ZONE, items, sources

_HEAT = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.HEAT_TYPES.items()) + " ELSE 0.35 END"
_PICK = "CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.SELECTION_TYPES.items()) + " ELSE 0.6 END"
_HEAT_SQL = f"""scored AS (SELECT i.*, s.tier, s.organization, round(pow(0.5, greatest(epoch(TIMESTAMP '{NOW}') - epoch(coalesce(published_at, observed_at)), 0) / 3600.0 / 18.0) * {_HEAT} *
 (CASE tier WHEN 'primary' THEN 30.0 WHEN 'expert' THEN 18.0 WHEN 'secondary' THEN 12.0 ELSE 6.0 END + 20.0 * ln(1 + item_id % 4) + 0.15 * coalesce(nullif(quality, 0), 50.0)), 3) AS heat,
 round(0.34 * coalesce(quality, 50.0) + 17 * CASE tier WHEN 'primary' THEN 1.0 WHEN 'expert' THEN 0.85 WHEN 'secondary' THEN 0.7 ELSE 0.5 END + 17 * {_PICK}
 + 0.09 * greatest(0.0, 100.0 - (epoch(TIMESTAMP '{NOW}') - epoch(coalesce(published_at, observed_at))) / 3600.0 / 72.0 * 100.0) + 8 * least(length(body) / 4000.0, 1.0) + 15 * least(ln(1 + item_id % 4) / ln(4), 1.0), 2) AS score,
 CAST(CAST(timezone('{ZONE}', timezone('UTC', coalesce(published_at, observed_at))) AS DATE) AS VARCHAR) AS day FROM item i JOIN source s USING (source_id))"""


def scored(spark, sf_dir):
    """Items with heat, selection score and local day; how many outlets: item_id mod 4 + 1."""
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir)), "source_id")
    at = F.coalesce("published_at", "observed_at")
    age, outlets = scores.hours_before(F.lit(NOW), at), F.col("item_id") % 4 + 1
    return rows.select(
        "*",
        scores.heat(age, F.col("tier"), F.col("content_type"), F.col("quality"), outlets).alias("heat"),
        scores.selection(age, F.col("tier"), F.col("content_type"), F.col("quality"), F.length("body"), outlets).alias("score"),
        F.to_date(F.from_utc_timestamp(at.cast("timestamp"), ZONE)).cast("string").alias("day"),
    )


@query(f"WITH {SQL}, {_HEAT_SQL} SELECT item_id, round(heat, 2) AS heat FROM scored")
def g10_heat(spark, sf_dir):
    return scored(spark, sf_dir).select("item_id", F.round("heat", 2).alias("heat"))


@query(f"WITH {SQL}, {_HEAT_SQL} SELECT item_id, round(score, 1) AS score FROM scored")
def g11_selection_score(spark, sf_dir):
    return scored(spark, sf_dir).select("item_id", F.round("score", 1).alias("score"))


_FACTORS = {
    "quality": "coalesce(quality, 50e0)", "source_tier": "100 * CASE tier WHEN 'primary' THEN 1e0 WHEN 'expert' THEN 0.85e0 WHEN 'secondary' THEN 0.7e0 ELSE 0.5e0 END",
    "content_type": "100 * CASE content_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in scores.SELECTION_TYPES.items()) + " ELSE 0.6e0 END",
    "freshness": f"greatest(0e0, 100e0 - (epoch(TIMESTAMP '{NOW}') - epoch(coalesce(published_at, observed_at))) / 3600e0 / 72e0 * 100e0)",
    "body_depth": "100 * least(length(body) / 4000e0, 1e0)", "corroboration": "100 * least(ln(1 + item_id % 4) / ln(4), 1e0)",
}
_RANKED = "[" + ", ".join(f"{{'v': -({_FACTORS[name]}), 'k': {k}, 'label': '{label}'}}" for k, (name, label) in enumerate(scores.REASONS.items())) + "]"


@query(f"WITH {SQL}, {_HEAT_SQL} SELECT item_id, array_to_string(list_transform(list_filter(list_sort({_RANKED})[1:3], lambda f: f.v < 0), lambda f: f.label), '、') AS reasons FROM scored")
def g11_selection_reasons(spark, sf_dir):
    """What speaks most for each item: its three greatest factors."""
    age, outlets = scores.hours_before(F.lit(NOW), F.coalesce("published_at", "observed_at")), F.col("item_id") % 4 + 1
    reasons = scores.selection_reasons(age, F.col("tier"), F.col("content_type"), F.col("quality"), F.length("body"), outlets)
    return items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir)), "source_id").select("item_id", reasons.alias("reasons"))


@query(f"WITH {SQL}, {_HEAT_SQL} SELECT item_id, content_type, heat FROM scored ORDER BY heat DESC, item_id LIMIT 20")
def e6_hot_list(spark, sf_dir):
    return scored(spark, sf_dir).select("item_id", "content_type", "heat").orderBy(F.desc("heat"), "item_id").limit(20)


def capped_selection(rows, quota: int = 12, per_source: int = 3):
    """The best of each day, at most ``per_source`` of a source: ranks within (day, source)
    first, so that only few rows of a day meet in one window."""
    best = W.partitionBy("day", "source_id").orderBy(F.desc("score"), "item_id")
    kept = rows.withColumn("by_source", F.row_number().over(best)).filter(F.col("by_source") <= per_source)
    return kept.withColumn("position", F.row_number().over(W.partitionBy("day").orderBy(F.desc("score"), "item_id"))).filter(F.col("position") <= quota)


@query(f"""WITH {SQL}, {_HEAT_SQL}, s AS (SELECT day, source_id, item_id, score, row_number() OVER (PARTITION BY day, source_id ORDER BY score DESC, item_id) AS r FROM scored)
SELECT day, source_id, item_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, item_id) AS position FROM s WHERE r <= 3) WHERE position <= 12""")
def e9_daily_selection(spark, sf_dir):
    return capped_selection(scored(spark, sf_dir)).select("day", "source_id", "item_id", "score", F.col("position").cast("long").alias("position"))


@query(f"""WITH {SQL}, {_HEAT_SQL}, s AS (SELECT day, item_id, score, CASE WHEN item_id % 7 > 1 THEN item_id // 5 END AS story FROM scored) SELECT day, item_id, story FROM (SELECT *, row_number() OVER (PARTITION BY day, story ORDER BY score DESC, item_id) AS r FROM s) WHERE r = 1 OR story IS NULL""")
def e10_collapse_by_story(spark, sf_dir):
    """The best item of each story a day; items without a story stay."""
    rows = scored(spark, sf_dir).select("day", "item_id", "score", F.when(F.col("item_id") % 7 > 1, F.floor(F.col("item_id") / 5)).alias("story"))
    best = rows.filter("story is not null").groupBy("day", "story").agg(F.max_by("item_id", F.struct("score", -F.col("item_id"))).alias("item_id"))
    return best.select("day", "item_id", "story").union(rows.filter("story is null").select("day", "item_id", "story"))


@query(f"""WITH {SQL}, {_HEAT_SQL}, days AS (SELECT DISTINCT day FROM scored) SELECT day, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next FROM days""")
def e7_report_navigation(spark, sf_dir):
    days = scored(spark, sf_dir).select("day").distinct()  # as many rows as days
    order = W.orderBy("day")
    return days.select("day", F.lag("day").over(order).alias("previous"), F.lead("day").over(order).alias("next"))


@query(f"""WITH {SQL}, {_HEAT_SQL}, p AS (SELECT day, item_id, source_id, organization, content_type, tier, length(regexp_replace(body, '\\s', '', 'g')) AS chars FROM scored)
SELECT day, count(*) AS items, count(DISTINCT content_type) AS sections, count(DISTINCT source_id) AS sources, count(DISTINCT organization) AS outlets,
 count(*) FILTER (WHERE tier = 'primary') AS primary_items, CAST(greatest(1, ceil(sum(chars) / 500.0)) AS BIGINT) AS reading_minutes FROM p GROUP BY day""")
def d20_report_stats(spark, sf_dir):
    chars = F.length(F.regexp_replace("body", r"\s", ""))
    return scored(spark, sf_dir).groupBy("day").agg(
        F.count("*").alias("items"),
        F.countDistinct("content_type").alias("sections"),
        F.countDistinct("source_id").alias("sources"),
        F.countDistinct("organization").alias("outlets"),
        F.count_if(F.col("tier") == "primary").alias("primary_items"),
        F.greatest(F.lit(1), F.ceil(F.sum(chars) / 500.0)).cast("long").alias("reading_minutes"),
    )


@query(f"""WITH {SQL}, {_HEAT_SQL} SELECT organization, day, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS source_names FROM scored GROUP BY ALL""")
def d21_story_sources(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("organization", "day").agg(F.array_join(F.sort_array(F.collect_set("source_id")), ",").alias("source_names"))


@query(f"""WITH {SQL}, {_HEAT_SQL}, t AS (SELECT content_type, item_id, md5(CAST(item_id AS VARCHAR) || 'seed') AS h FROM scored)
SELECT content_type, item_id, population FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY h, item_id) AS r, count(*) OVER (PARTITION BY content_type) AS population FROM t) WHERE r <= 5""")
def e3_stratified_sample(spark, sf_dir):
    rows = items(spark, sf_dir).select("content_type", "item_id", F.md5(F.concat(F.col("item_id").cast("string"), F.lit("seed"))).alias("h"))
    sizes = rows.groupBy("content_type").agg(F.count("*").alias("population"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("content_type").orderBy("h", "item_id"))).filter("r <= 5")
    return ranked.join(F.broadcast(sizes), "content_type").select("content_type", "item_id", "population")
