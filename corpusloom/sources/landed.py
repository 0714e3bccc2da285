"""Landed payloads (sitemaps, feeds, API answers, changelogs, release lists, golden questions) as rows of documents.

Each function takes a frame with an id and a payload and gives one row per entry; parsing
stays in SQL functions. The payloads of the registered queries are made from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parts of paths that no article has, and parts that articles have.
NOT_ARTICLES = ["/tag/", "/tags/", "/category/", "/categories/", "/author/", "/page/", "/search", "/login", "/signup", "/pricing", "/careers", "/contact", "/privacy", "/terms", "/rss", "/feed", "/about"]
ARTICLE_PATHS = ["/article/", "/articles/", "/blog/", "/news/", "/posts/"]
# The least downloads of a notable model.
MIN_DOWNLOADS = 5000
# Months by name.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _any(col: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | col.contains(p)
    return found


def flatten_sitemap(payloads: DataFrame) -> DataFrame:
    """payload_id, url, position from payload_id, host, xml: article pages of the same host over https,
    the newest modification first, unknown ones last, equal ones as they stand."""
    blocks = payloads.select("payload_id", "host", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("place", "block"))
    raw = F.trim(F.regexp_extract("block", r"(?s)<loc>(.*?)</loc>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    rows = blocks.select("*", raw.alias("url"), F.regexp_extract("block", r"(?s)<lastmod>(.*?)</lastmod>", 1).try_cast("timestamp").alias("modified"))
    rows = rows.filter(F.lower(F.regexp_extract("url", r"^https://([^/?#]*)", 1)) == F.lower("host"))
    path = F.lower(F.regexp_extract("url", r"^https://[^/?#]*([^?#]*)", 1))
    named = _any(path, ARTICLE_PATHS) & (F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1) != "")
    rows = rows.filter(~_any(path, NOT_ARTICLES) & (named | F.regexp_like(path, F.lit(r"^/p/\d+\.html$"))))
    order = W.partitionBy("payload_id").orderBy(F.desc_nulls_last("modified"), "place")
    return rows.select("payload_id", "url", F.row_number().over(order).cast("bigint").alias("position"))


FEED = "channel struct<item: array<struct<id: string, guid: string, link: string, title: string, published: string, updated: string, description: string>>>"


def flatten_feed(payloads: DataFrame) -> DataFrame:
    """payload_id, external_id, link, title, published, summary from payload_id, cursor, xml: entries with a
    link that are newer than the cursor or have no time; the id is id, guid or the link's digest."""
    rows = payloads.select("payload_id", "cursor", F.explode(F.from_xml("xml", FEED)["channel"]["item"]).alias("e"))
    at = F.coalesce(F.col("e.published").try_cast("timestamp"), F.col("e.updated").try_cast("timestamp"))
    rows = rows.withColumn("published", at).filter(F.col("e.link").isNotNull() & (F.col("published").isNull() | F.col("cursor").isNull() | (F.col("published") > F.col("cursor"))))
    return rows.select("payload_id", F.coalesce("e.id", "e.guid", F.sha2("e.link", 256)).alias("external_id"), F.col("e.link").alias("link"), F.col("e.title").alias("title"), "published", F.col("e.description").alias("summary"))


def flatten_models(payloads: DataFrame) -> DataFrame:
    """payload_id, external_id, downloads, modified from payload_id, cursor, body: notable models newer than the cursor."""
    kind = "array<struct<id: string, modelId: string, downloads: bigint, lastModified: string>>"
    rows = payloads.select("payload_id", "cursor", F.explode(F.from_json("body", kind)).alias("m"))
    rows = rows.select("payload_id", "cursor", F.coalesce("m.id", "m.modelId").alias("name"), F.coalesce("m.downloads", F.lit(0)).alias("downloads"), F.col("m.lastModified").try_cast("timestamp").alias("modified"))
    fresh = F.col("modified").isNull() | F.col("cursor").isNull() | (F.col("modified") > F.col("cursor"))
    return rows.filter(F.col("name").isNotNull() & (F.col("downloads") >= MIN_DOWNLOADS) & fresh).select("payload_id", F.concat(F.lit("hf:"), "name").alias("external_id"), "downloads", "modified")


def abstract_of(inverted: Column) -> Column:
    """The text of a JSON map from words to their places."""
    places = F.map_entries(F.from_json(inverted, "map<string, array<int>>"))
    pairs = F.flatten(F.transform(places, lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " "), F.lit(""))


def heading_date(heading: Column) -> Column:
    """A date in a heading: 2024-01-31 or 2024/1/31, 2024年1月31日, January 31, 2024; null for none or an impossible one."""
    name = r"(?i)(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),?\s+(\d{4})"
    part = lambda p, k: F.nullif(F.regexp_extract(heading, p, k), F.lit("")).cast("int")
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(heading, name, 1))), F.lit(0)).cast("int")
    forms = [(part(p, 1), part(p, 2), part(p, 3)) for p in (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日")]
    forms.append((part(name, 3), month, part(name, 2)))
    dates = [F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(f, (4, 2, 2))]) for f in forms]
    return F.coalesce(*[F.when(F.length(d) == 10, d.try_cast("date")) for d in dates])


def split_changelog(payloads: DataFrame, seen: DataFrame) -> DataFrame:
    """payload_id, anchor, heading, published, section_hash from payload_id, xml: the sections of a page
    whose digest (``seen``: section_hash) isn't known. What stands before the first heading goes."""
    pieces = payloads.select("payload_id", F.posexplode(F.split("xml", "<head[^>]*>")).alias("place", "piece")).filter("place > 0")
    heading = F.trim(F.regexp_replace(F.regexp_extract("piece", r"(?s)^(.*?)</head>", 1), "<[^>]+>", ""))
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract("piece", r"(?s)^.*?</head>(.*)$", 1), "<[^>]+>", "\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = pieces.select("payload_id", "place", heading.alias("heading"), F.array_join(lines, "\n").alias("body")).filter("heading <> '' and body <> ''")
    rows = rows.withColumn("section_hash", F.sha2(F.concat_ws("\n", "heading", "body"), 256)).join(seen, "section_hash", "left_anti")
    anchor = F.substring(F.trim(F.regexp_replace(F.lower("heading"), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)
    return rows.select("payload_id", F.coalesce(F.nullif(anchor, F.lit("")), (F.col("place") - 1).cast("string")).alias("anchor"), "heading", heading_date(F.col("heading")).alias("published"), "section_hash")


def flatten_releases(payloads: DataFrame) -> DataFrame:
    """payload_id, external_id, title, published, prerelease from payload_id, cursor, body: releases that are no
    drafts and have a page, up to the first that isn't newer than the cursor (lists are newest first)."""
    kind = "array<struct<id: bigint, draft: boolean, prerelease: boolean, published_at: string, html_url: string, name: string, tag_name: string>>"
    rows = payloads.select("payload_id", "cursor", F.posexplode(F.from_json("body", kind)).alias("place", "r")).filter(~F.coalesce("r.draft", F.lit(False)))
    rows = rows.withColumn("published", F.col("r.published_at").try_cast("timestamp"))
    stop = F.min(F.when(F.col("published") <= F.col("cursor"), F.col("place"))).over(W.partitionBy("payload_id"))
    rows = rows.withColumn("stop", stop).filter((F.col("stop").isNull() | (F.col("place") < F.col("stop"))) & (F.coalesce("r.html_url", F.lit("")) != ""))
    return rows.select("payload_id", F.col("r.id").cast("string").alias("external_id"), F.coalesce(F.nullif(F.col("r.name"), F.lit("")), "r.tag_name").alias("title"), "published", F.coalesce("r.prerelease", F.lit(False)).alias("prerelease"))


def golden_violations(questions: DataFrame, judged: DataFrame, distractors: DataFrame, per_category: int = 15) -> DataFrame:
    """question_id, problem from questions (question_id, category, answerable), judged (question_id, item_id, grade)
    and distractors (question_id, item_id, reason): every rule that a golden set breaks."""
    counts = judged.groupBy("question_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("distinct_items"), F.count_if(~F.col("grade").isin(1, 2)).alias("bad"))
    marked = questions.join(counts, "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = lambda rows, problem: rows.select(F.col("question_id").cast("string").alias("question_id"), F.lit(problem).alias("problem"))
    out = of(marked.filter("answerable and n = 0"), "answerable_without_items")
    out = out.union(of(marked.filter("not answerable and n > 0"), "unanswerable_with_items"))
    out = out.union(of(marked.filter("bad > 0"), "grade")).union(of(marked.filter("n > distinct_items"), "duplicate_items"))
    out = out.union(of(judged.select("question_id", "item_id").distinct().join(distractors.select("question_id", "item_id"), ["question_id", "item_id"], "left_semi").select("question_id").distinct(), "relevant_distractor"))
    out = out.union(of(distractors.filter(F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0).select("question_id").distinct(), "reason"))
    few = questions.groupBy("category").agg(F.count("*").alias("n")).filter(F.col("n") < per_category)
    return out.union(few.select(F.col("category").alias("question_id"), F.lit("few_in_category")))
