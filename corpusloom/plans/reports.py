"""Reports of days, weeks and months from the daily choice: entries, gate, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.graph import Rounds
from corpusloom.plans.feeds import LEAST_ITEMS, SECTIONS
from corpusloom.plans.registry import query
from corpusloom.plans.scoring import scored
from corpusloom.plans.stories import chosen_daily, families
from corpusloom.sources.products import publish

FIELDS = ["item_id", "title", "source_id", "content_type", "url", "story", "score", "outlets"]


def periods_of(days):
    """period, key, since, until (a day, inclusive) of all days, weeks and months that the days (a column day) lie in."""
    date = F.col("day").cast("date")
    month, week = F.trunc(date, "month"), F.to_date(F.date_trunc("week", date))
    iso = F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    kinds = [("daily", F.col("day"), date, date), ("weekly", iso, week, F.date_add(week, 6)), ("monthly", F.substring("day", 1, 7), month, F.last_day(month))]
    every = F.inline(F.array(*[F.struct(F.lit(p).alias("period"), k.alias("key"), a.alias("since"), b.alias("until")) for p, k, a, b in kinds]))
    return days.select(every).distinct()


def entries(chosen):
    """period, key and the entry of each story (chosen: day and all ``FIELDS`` but outlets): its best item, with how many sources have it.
    An item without a story is its own.

    A day's choice is bounded by its quota, so a month's entries are as well. Days are joined to the
    periods that they lie in by equality, each day with its three.
    """
    days = chosen.select("day").distinct()
    spans = periods_of(days).withColumn("day", F.explode(F.sequence("since", "until"))).select("period", "key", F.col("day").cast("string").alias("day"))
    told = F.coalesce(F.concat(F.lit("s"), F.col("story").cast("string")), F.concat(F.lit("i"), F.col("item_id").cast("string")))
    rows = chosen.join(spans, "day").withColumn("told", told)
    best = F.max_by(F.struct(*FIELDS[:-1]), F.struct("score", -F.col("item_id"))).alias("e")
    return rows.groupBy("period", "key", "told").agg(best, F.countDistinct("source_id").alias("outlets")).select("period", "key", "e.*", "outlets")


def reports(chosen, summaries):
    """A report for each period: entries in the order of sections, then of scores; what forbids its publication; status; digest.

    summaries: (period, key) of the reports that have one.
    """
    e = F.col("entry")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), F.coalesce("content_type", F.lit(""))), F.lit(0))
    rows = entries(chosen).select("period", "key", F.struct(F.when(place == 0, len(SECTIONS) + 1).otherwise(place).alias("place"), (-F.col("score")).alias("below"), *FIELDS).alias("entry"))
    bare = F.trim(F.coalesce(e["title"], F.lit(""))) == ""
    faults = [
        ("invalid_canonical_url", ~F.coalesce(F.regexp_like(e["url"], F.lit("^https?://[^/]")), F.lit(False))),
        ("missing_identity", bare | (F.trim(F.coalesce(e["source_id"], F.lit(""))) == "")),
        ("missing_story", e["story"].isNull()),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.concat(F.lit(f"{name}:"), e["item_id"].cast("string"))) for name, hit in faults]))
    made = rows.groupBy("period", "key").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.array_sort(F.flatten(F.collect_list(found))).alias("faults"))
    made = made.join(summaries.select("period", "key", F.lit(True).alias("told")), ["period", "key"], "left")
    n, least = F.size("entries"), F.create_map(*[F.lit(v) for pair in LEAST_ITEMS.items() for v in pair])[F.col("period")]
    few = F.when(n < least, F.concat(F.lit("too_few_items:"), n.cast("string"), F.lit("<"), least.cast("string")))
    reasons = F.concat(F.array_compact(F.array(few, F.when(F.col("told").isNull(), "missing_summary"))), F.col("faults"))
    made = made.select("period", "key", n.cast("long").alias("items"), reasons.alias("reasons"), "entries")
    status = F.when(F.size("reasons") > 0, "REVIEW_REQUIRED").otherwise("PUBLISHED")
    return made.withColumns({"status": status, "digest": F.sha2(F.to_json(F.struct("reasons", "entries")), 256)})


def candidates(spark, sf_dir):
    """Items with all that a report needs. Bindings: some URLs and stories are missing by number."""
    k = F.col("item_id")
    url = F.when(k % 97 == 0, "ftp://example.com/x").when(k % 89 != 0, F.concat(F.lit("https://example.com/"), k.cast("string")))
    return families(scored(spark, sf_dir)).select("day", "item_id", "title", "source_id", "family", "content_type", "score", url.alias("url"), F.when(k % 83 > 0, F.floor(k / 5)).alias("story"))


def built(rows):
    """The reports of candidates: the daily choice under all its caps, then ``reports``. Binding: keys that end in 3 have no summary."""
    few = chosen_daily(rows.select("day", "item_id", "family", "content_type", "score"))
    chosen = rows.join(few.select("day", "item_id"), ["day", "item_id"])
    return reports(chosen, periods_of(rows.select("day").distinct()).filter(~F.col("key").endswith("3")))


@query()
def i9_report_products(spark, sf_dir):
    """Reports published twice: before the items that came late (of each seven the last), then with all. A report that these
    change has a second version; the others stay as they were."""
    path = f"{Rounds(spark, 'reports').root}/reports"
    rows = candidates(spark, sf_dir)
    publish(built(rows.filter("item_id % 7 < 6")), path, ["period", "key"], "digest")
    now = publish(built(rows), path, ["period", "key"], "digest")
    return now.select("period", "key", "version", "status", "items", "reasons", F.transform("entries", lambda e: e["item_id"]).alias("item_ids"), F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + e["outlets"]).alias("outlets"))
