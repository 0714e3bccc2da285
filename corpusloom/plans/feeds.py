"""Feeds, stories and reports over items: gates, joins, counts and rendered texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import search_tokens
from corpusloom.plans.reads import _DAY, _FIRST, _TOPICS, _with_day, labelled, with_canonical
from corpusloom.plans.registry import query
from corpusloom.sources.tables import SQL, items, passages, read_tables, sources

# Authority of a source by its tier.
AUTHORITY = {"primary": 90.0, "secondary": 65.0, "expert": 75.0, "community": 40.0}
# Fixed values of these bindings: retired topics and where they go (None: dropped).
MERGED = {"tutorial": "learning", "business": "industry", "policy": "industry", "opinion": None}
# The order of sections.
SECTIONS = ["model_release", "product_release", "api_update", "open_source", "research", "security", "business", "policy", "tutorial", "opinion"]


def _mapped(col, values: dict, default):
    out = None
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(default)


def _case(col: str, values: dict, default: str) -> str:
    say = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {say(v)}" for k, v in values.items()) + f" ELSE {default} END"


@query(f"""WITH {SQL} SELECT item_id, round(greatest(0e0, least(100e0, 0.3e0 * {_case("tier", AUTHORITY, "50")} + 0.25e0 * (item_id % 101) + 0.25e0 * (length(body) % 101)
  + 0.2e0 * least(100e0, length(body) / 40e0) - CASE WHEN item_id % 9 = 0 THEN 20 ELSE 0 END)), 6) AS quality_score FROM item JOIN source USING (source_id)""")
def b8_quality_score(spark, sf_dir):
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier")), "source_id")
    length = F.length("body")
    parts = 0.3 * _mapped(F.col("tier"), AUTHORITY, F.lit(50.0)) + 0.25 * (F.col("item_id") % 101) + 0.25 * (length % 101) + 0.2 * F.least(F.lit(100.0), length / 40.0)
    spam = F.when(F.col("item_id") % 9 == 0, 20.0).otherwise(0.0)
    return rows.select("item_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), parts - spam)), 6).alias("quality_score"))


@query(f"WITH {SQL}, f AS ({_FIRST}) SELECT item_id, title FROM f WHERE canonical_id = item_id AND quality IS NOT NULL AND length(trim(title)) > 0 AND length(trim(body)) > 0")
def b9_public_feed_ready(spark, sf_dir):
    ready = with_canonical(items(spark, sf_dir)).filter("canonical_id = item_id and quality is not null")
    return ready.filter((F.length(F.trim("title")) > 0) & (F.length(F.trim("body")) > 0)).select("item_id", "title")


KEYWORDS = ["that", "schen"]


@query(f"""WITH {SQL}, k AS (SELECT unnest({KEYWORDS}) AS keyword) SELECT keyword, item_id, title FROM item, k WHERE list_contains(regexp_extract_all(lower(title || ' ' || source_id), '[\\p{{L}}\\p{{N}}_]+'), keyword) OR contains(lower(title), keyword)""")
def b11_keyword_feed_filter(spark, sf_dir):
    """Items that have a keyword among their tokens or, in any case, inside their title."""
    rows = items(spark, sf_dir).select("item_id", "title", search_tokens(F.concat_ws(" ", "title", "source_id")).alias("t"))
    fits = lambda k: F.when(F.array_contains("t", k) | F.lower("title").contains(k), F.lit(k))
    return rows.select(F.explode(F.array_compact(F.array(*[fits(k) for k in KEYWORDS]))).alias("keyword"), "item_id", "title")


@query(f"WITH {SQL}, b AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN '  ' WHEN item_id % 9 = 1 THEN substr(body, 1, 150) ELSE body END AS body, item_id % 4 = 0 AS done FROM item) SELECT item_id, CASE WHEN done THEN 'ENRICHED' WHEN length(trim(body)) = 0 THEN 'SKIPPED' ELSE 'PENDING' END AS status, CASE WHEN NOT done AND length(trim(body)) BETWEEN 1 AND 199 THEN 'thin_body' END AS skip_reason FROM b")
def b14_close_empty_bodies(spark, sf_dir):
    """Pending items without a body are skipped; a body of under 200 characters is not worth a call (here: some are emptied or cut)."""
    k = F.col("item_id") % 9
    body = F.when(k == 0, "  ").when(k == 1, F.substring("body", 1, 150)).otherwise(F.col("body"))
    size, done = F.length(F.trim(body)), F.col("item_id") % 4 == 0
    return items(spark, sf_dir).select("item_id", F.when(done, "ENRICHED").when(size == 0, "SKIPPED").otherwise("PENDING").alias("status"), F.when(~done & size.between(1, 199), "thin_body").alias("skip_reason"))


LEAST_ITEMS = {"daily": 5, "weekly": 5, "monthly": 10}
_PERIODS = f"""entry AS (SELECT item_id, title, source_id, day, unnest(['daily', 'weekly', 'monthly']) AS period, unnest([day, isoyear(CAST(day AS DATE)) || '-W' || lpad(CAST(week(CAST(day AS DATE)) AS VARCHAR), 2, '0'), substr(day, 1, 7)]) AS key,
  CASE WHEN item_id % 97 = 0 THEN 'ftp://example.com/x' WHEN item_id % 89 = 0 THEN NULL ELSE 'https://example.com/' || item_id END AS url, CASE WHEN item_id % 83 > 0 THEN 's' || (item_id // 5) END AS story FROM (SELECT *, {_DAY} AS day FROM item)),
gate AS (SELECT period, key, count(*) AS items, list_sort(list_distinct(flatten(list(list_filter([CASE WHEN NOT coalesce(regexp_matches(url, '^https?://[^/]'), false) THEN 'invalid_canonical_url:' || item_id END, CASE WHEN trim(title) = '' OR trim(source_id) = '' THEN 'missing_identity:' || item_id END, CASE WHEN story IS NULL THEN 'missing_story:' || item_id END], lambda x: x IS NOT NULL))))) AS reasons FROM entry GROUP BY ALL),
report AS (SELECT period, key, items, list_concat(list_filter([CASE WHEN items < CASE period WHEN 'monthly' THEN 10 ELSE 5 END THEN 'too_few_items:' || items || '<' || CASE period WHEN 'monthly' THEN 10 ELSE 5 END END, CASE WHEN ends_with(key, '3') THEN 'missing_summary' END], lambda x: x IS NOT NULL), reasons) AS reasons FROM gate)"""


def report_gate(spark, sf_dir):
    """period, key, items, reasons of the reports of each day, week and month: everything that forbids their publication.

    Only the entries with a fault are gathered. Bindings: some URLs, stories and summaries are missing by number.
    """
    k, date = F.col("item_id"), F.col("day").cast("date")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))
    periods = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), c.alias("key")) for p, c in (("daily", F.col("day")), ("weekly", week), ("monthly", F.substring("day", 1, 7)))])).alias("p")
    url = F.when(k % 97 == 0, "ftp://example.com/x").when(k % 89 == 0, None).otherwise(F.concat(F.lit("https://example.com/"), k.cast("string")))
    says = lambda fault, name: F.when(fault, F.concat(F.lit(f"{name}:"), k.cast("string")))
    faults = F.array_compact(F.array(says(~F.coalesce(F.regexp_like(url, F.lit("^https?://[^/]")), F.lit(False)), "invalid_canonical_url"), says((F.trim("title") == "") | (F.trim("source_id") == ""), "missing_identity"), says(k % 83 == 0, "missing_story")))
    rows = _with_day(items(spark, sf_dir)).select(periods, faults.alias("faults"))
    found = rows.groupBy("p.period", "p.key").agg(F.count("*").alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("faults") > 0, F.col("faults")))))).alias("reasons"))
    least = F.create_map(*[F.lit(v) for pair in LEAST_ITEMS.items() for v in pair])[F.col("period")]
    few = F.when(F.col("items") < least, F.concat(F.lit("too_few_items:"), F.col("items").cast("string"), F.lit("<"), least.cast("string")))
    return found.withColumn("reasons", F.concat(F.array_compact(F.array(few, F.when(F.col("key").endswith("3"), "missing_summary"))), F.col("reasons")))


@query(f"WITH {SQL}, {_PERIODS} SELECT period, key, items, CASE WHEN len(reasons) > 0 THEN 'REVIEW_REQUIRED' ELSE 'PUBLISHED' END AS status, len(reasons) AS faults, md5(array_to_string(reasons, ',')) AS reasons_digest FROM report")
def b17_publication_gate(spark, sf_dir):
    """Each report's status, and how many and which reasons stand against it."""
    faults = F.size("reasons")
    return report_gate(spark, sf_dir).select("period", "key", "items", F.when(faults > 0, "REVIEW_REQUIRED").otherwise("PUBLISHED").alias("status"), faults.cast("long").alias("faults"), F.md5(F.array_join("reasons", ",")).alias("reasons_digest"))


@query(f"WITH {SQL}, {_PERIODS} SELECT period, count(*) FILTER (WHERE len(reasons) = 0) AS published, count(*) FILTER (WHERE len(reasons) > 0) AS review_required FROM report WHERE NOT ends_with(key, '5') GROUP BY period")
def d31_backfill_counts(spark, sf_dir):
    """What the gate says of the stored drafts (here: keys that don't end in 5)."""
    faults = F.size("reasons")
    return report_gate(spark, sf_dir).filter(~F.col("key").endswith("5")).groupBy("period").agg(F.count_if(faults == 0).alias("published"), F.count_if(faults > 0).alias("review_required"))


@query(f"WITH {SQL} SELECT item_id FROM item i WHERE EXISTS (SELECT 1 FROM passage p WHERE p.item_id = i.item_id AND length(p.passage) > 400)")
def c4_semi_join(spark, sf_dir):
    long = passages(spark, sf_dir).filter(F.length("passage") > 400).select("item_id")
    return items(spark, sf_dir).select("item_id").join(long, "item_id", "left_semi")


@query(f"""WITH {SQL} SELECT item_id, tier, content_type, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(title, '[A-Z][a-z]+'))), ','), '') AS entities
  FROM item JOIN source USING (source_id)""")
def c8_load_item_metadata(spark, sf_dir):
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier")), "source_id")
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("title", F.lit("([A-Z][a-z]+)"), 1)))
    return rows.select("item_id", "tier", "content_type", F.coalesce(F.array_join(names, ","), F.lit("")).alias("entities"))


@query("""SELECT doc_id, 'unlabelled' AS drift FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  UNION ALL SELECT doc_id, 'missing' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def c13_audit_bindings(spark, sf_dir):
    docs, labels = (t.select("doc_id") for t in read_tables(spark, sf_dir, "documents", "labels"))
    return docs.join(labels, "doc_id", "left_anti").withColumn("drift", F.lit("unlabelled")).unionByName(labels.join(docs, "doc_id", "left_anti").withColumn("drift", F.lit("missing")))


@query(f"WITH {SQL}, f AS ({_FIRST}) SELECT item_id, source_id FROM f WHERE canonical_id = item_id AND quality IS NULL AND length(trim(body)) > 0 ORDER BY item_id DESC LIMIT 50")
def c16_pending_items(spark, sf_dir):
    """The newest 50 items that wait for labels: the batch that is taken next."""
    open_ = with_canonical(items(spark, sf_dir)).filter("canonical_id = item_id and quality is null").filter(F.length(F.trim("body")) > 0)
    return open_.select("item_id", "source_id").orderBy(F.desc("item_id")).limit(50)


@query(f"""WITH {SQL} SELECT tier, count(*) AS registered, count(*) FILTER (WHERE n % 5 <> 0) AS enabled, count(*) FILTER (WHERE n % 5 = 0) AS disabled, CAST(max(latest) AS VARCHAR) AS latest
  FROM source LEFT JOIN (SELECT source_id, CAST(max(greatest(observed_at, published_at)) AS DATE) AS latest FROM item GROUP BY source_id) USING (source_id) GROUP BY tier""")
def d8_source_summary(spark, sf_dir):
    latest = items(spark, sf_dir).groupBy("source_id").agg(F.max(F.greatest("observed_at", "published_at")).cast("date").alias("latest"))
    return sources(spark, sf_dir).join(latest, "source_id", "left").groupBy("tier").agg(
        F.count("*").alias("registered"), F.count_if(F.col("n") % 5 != 0).alias("enabled"), F.count_if(F.col("n") % 5 == 0).alias("disabled"), F.max("latest").cast("string").alias("latest")
    )


_STORY = "SELECT *, item_id // 5 AS story_id, coalesce(published_at, observed_at) AS moment, 0.6e0 + (length(body) % 40) / 100e0 AS similarity FROM item"


def _stories(rows, size: int = 5):
    return rows.select("*", F.floor(F.col("item_id") / size).alias("story_id"), F.coalesce("published_at", "observed_at").alias("at"), (F.length("body") % 40 / 100.0 + 0.6).alias("similarity"))


@query(f"""WITH {SQL} SELECT story_id, count(*) AS members, count(DISTINCT source_id) AS outlets, round(min(similarity), 6) AS similarity FROM ({_STORY.replace("item_id // 5", "item_id // 2")}) WHERE item_id // 2 % 5 > 0 GROUP BY story_id
  HAVING count(DISTINCT source_id) >= 2 AND count(quality) >= count(*) - 1 AND round(min(similarity), 6) >= 0.67e0""")
def d22_story_public_filter(spark, sf_dir):
    """Published stories (here: four of five pairs of neighbours) of at least two sources, all members but the first with a score,
    none less similar than 0.67."""
    rows = _stories(items(spark, sf_dir), 2).filter("story_id % 5 > 0")
    found = rows.groupBy("story_id").agg(F.count("*").alias("members"), F.countDistinct("source_id").alias("outlets"), F.round(F.min("similarity"), 6).alias("similarity"), F.count("quality").alias("scored"))
    return found.filter("outlets >= 2 and scored >= members - 1 and similarity >= 0.67D").drop("scored")


@query(f"""WITH {SQL} SELECT source_id, sha256(concat_ws('|', count(*), CAST(CAST(max(observed_at) AS DATE) AS VARCHAR))) AS fingerprint, sha256(max({_DAY}) || '|' || count(*)) AS day_fingerprint FROM item GROUP BY source_id""")
def d24_corpus_fingerprint(spark, sf_dir):
    """Digests that change with a source's items: by their number and newest time, and by the newest local day."""
    found = _with_day(items(spark, sf_dir)).groupBy("source_id").agg(F.count("*").cast("string").alias("n"), F.max("observed_at").cast("date").cast("string").alias("latest"), F.max("day").alias("day"))
    return found.select("source_id", F.sha2(F.concat_ws("|", "n", "latest"), 256).alias("fingerprint"), F.sha2(F.concat_ws("|", "day", "n"), 256).alias("day_fingerprint"))


@query(f"""WITH {SQL} SELECT source_id, CASE WHEN accepted >= 2 THEN 'ACTIVE' WHEN total > accepted THEN 'METADATA_ONLY' END AS state
  FROM (SELECT source_id, count(*) AS total, count(*) FILTER (WHERE length(body) >= 2000) AS accepted FROM item GROUP BY source_id)""")
def d26_ingest_state(spark, sf_dir):
    found = items(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.length("body") >= 2000).alias("accepted"))
    return found.select("source_id", F.when(F.col("accepted") >= 2, "ACTIVE").when(F.col("total") > F.col("accepted"), "METADATA_ONLY").alias("state"))


@query(f"WITH {SQL} SELECT count(*) AS total, count(*) FILTER (WHERE observed_at <= TIMESTAMP '2024-01-02 00:00:00') AS included, count(*) FILTER (WHERE observed_at > TIMESTAMP '2024-01-02 00:00:00') AS ignored FROM item")
def d27_golden_snapshot(spark, sf_dir):
    inside = F.col("observed_at") <= F.lit("2024-01-02 00:00:00")
    return items(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(inside).alias("included"), F.count_if(~inside).alias("ignored"))


@query(f"WITH {SQL} SELECT organization, content_type, count(*) AS n, CAST(CAST(max(observed_at) AS DATE) AS VARCHAR) AS latest FROM item JOIN source USING (source_id) GROUP BY organization, content_type")
def d30_feed_totals(spark, sf_dir):
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "organization")), "source_id")
    return rows.groupBy("organization", "content_type").agg(F.count("*").alias("n"), F.max("observed_at").cast("date").cast("string").alias("latest"))


@query(f"WITH {SQL} SELECT story_id, item_id, row_number() OVER (PARTITION BY story_id ORDER BY moment, item_id) AS position FROM ({_STORY})")
def e8_story_timeline(spark, sf_dir):
    rows = _stories(items(spark, sf_dir)).select("story_id", "item_id", "at")
    return rows.select("story_id", "item_id", F.row_number().over(W.partitionBy("story_id").orderBy("at", "item_id")).alias("position"))


_SECTION = _case("content_type", {s: s for s in SECTIONS}, "'other'")
_ORDER = _case("content_type", {s: k for k, s in enumerate(SECTIONS)}, str(len(SECTIONS)))


@query(f"WITH {SQL}, s AS (SELECT {_DAY} AS day, item_id, CASE WHEN item_id % 12 = 7 THEN 'unnamed' ELSE content_type END AS content_type FROM item) SELECT day, item_id, {_SECTION} AS section, dense_rank() OVER (PARTITION BY day ORDER BY {_ORDER}) AS section_no FROM s")
def e11_sections(spark, sf_dir):
    """The section of each item of a day: in the fixed order, empty ones left out, what fits none at the end as other."""
    kind = F.col("content_type")
    rows = _with_day(items(spark, sf_dir)).select("day", "item_id", F.when(F.col("item_id") % 12 == 7, "unnamed").otherwise(kind).alias("content_type"))
    named, place = _mapped(kind, {s: s for s in SECTIONS}, F.lit("other")), _mapped(kind, {s: k for k, s in enumerate(SECTIONS)}, F.lit(len(SECTIONS)))
    rows = rows.select("day", "item_id", named.alias("section"), place.alias("place"))
    found = rows.select("day", "section", "place").distinct()  # as many rows as a day has sections
    found = found.withColumn("section_no", F.row_number().over(W.partitionBy("day").orderBy("place")).cast("long"))
    return rows.join(found.select("day", "section", "section_no"), ["day", "section"]).select("day", "item_id", "section", "section_no")


@query(f"""WITH {SQL}, {_PERIODS}, shown AS (SELECT key FROM report WHERE period = 'daily' AND len(reasons) = 0 ORDER BY key DESC LIMIT 10), o AS (SELECT story, count(DISTINCT source_id) AS outlets FROM entry WHERE period = 'daily' GROUP BY 1)
SELECT key, item_id, row_number() OVER (PARTITION BY key ORDER BY item_id) AS position, story, outlets FROM entry JOIN shown USING (key) JOIN o USING (story) WHERE period = 'daily' QUALIFY position <= 20""")
def e19_report_list(spark, sf_dir):
    """The entries (twenty a report) of the newest ten published daily reports, with their stories and how many sources these have."""
    gate = report_gate(spark, sf_dir).filter((F.col("period") == "daily") & (F.size("reasons") == 0))
    shown = gate.orderBy(F.desc("key")).limit(10).select("key")
    k = F.col("item_id")
    rows = _with_day(items(spark, sf_dir)).filter(k % 83 > 0).select("item_id", F.col("day").alias("key"), "source_id", F.concat(F.lit("s"), F.floor(k / 5).cast("string")).alias("story"))
    outlets = rows.groupBy("story").agg(F.countDistinct("source_id").alias("outlets"))
    position = F.row_number().over(W.partitionBy("key").orderBy("item_id")).cast("long")
    return rows.join(F.broadcast(shown), "key").withColumn("position", position).filter("position <= 20").join(outlets, "story").select("key", "item_id", "position", "story", "outlets")


@query(f"""WITH {SQL}, {_TOPICS} SELECT item_id, string_agg(topic, ',' ORDER BY confidence DESC NULLS LAST, topic) AS topics FROM labelled GROUP BY item_id""")
def e20_item_topics(spark, sf_dir):
    """All topics of an item in one array, the surest first, those without a confidence last."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("c"), "topic")
    return labelled(spark, sf_dir).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["topic"]), ",").alias("topics"))


@query(f"WITH {SQL} SELECT DISTINCT source_id, topic FROM (SELECT source_id, {_case('content_type', MERGED, 'content_type')} AS topic FROM item) WHERE topic IS NOT NULL")
def f7_merge_topics(spark, sf_dir):
    found = items(spark, sf_dir).select("source_id", _mapped(F.col("content_type"), MERGED, F.col("content_type")).alias("topic"))
    return found.filter("topic is not null").dropDuplicates()


_VERSION = r"(?:^|[^a-z0-9])(v\.?[0-9]+(?:\.[0-9]+)*|b[0-9]{3,}|[0-9]+\.[0-9]+(?:\.[0-9]+)*)"
_RELEASED = "lower(title) || CASE item_id % 5 WHEN 0 THEN ' V' || item_id WHEN 1 THEN ' b10' || (item_id % 90 + 10) WHEN 2 THEN ' 1.' || (item_id % 7) || '.0 and v1.' || (item_id % 7) || '.0' WHEN 3 THEN ' v.2' ELSE '' END"


@query(f"""WITH {SQL}, t AS (SELECT item_id, lower({_RELEASED}) AS t FROM item) SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_VERSION}', 1), lambda v: ltrim(ltrim(v, 'v'), '.')))), ',') AS versions FROM t WHERE regexp_matches(t, '{_VERSION}')""")
def g7_extract_versions(spark, sf_dir):
    """Version numbers and build numbers of titles (some are appended, as the titles hold none)."""
    k = F.col("item_id")
    n = (k % 7).cast("string")
    more = F.when(k % 5 == 0, F.concat(F.lit(" V"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit(" b10"), (k % 90 + 10).cast("string"))).when(k % 5 == 2, F.concat(F.lit(" 1."), n, F.lit(".0 and v1."), n, F.lit(".0"))).when(k % 5 == 3, " v.2").otherwise("")
    found = F.regexp_extract_all(F.lower(F.concat("title", more)), F.lit(_VERSION), F.lit(1))
    bare = F.transform(found, lambda v: F.regexp_replace(v, r"^v*\.*", ""))
    return items(spark, sf_dir).select("item_id", F.array_join(F.array_sort(F.array_distinct(bare)), ",").alias("versions")).filter("versions <> ''")


@query(f"""WITH {SQL} SELECT item_id, round(CASE WHEN before IS NULL THEN 0.5e0 ELSE greatest(0e0, 1 - (epoch(observed_at) - epoch(before)) / 259200e0) END, 6) AS proximity
  FROM (SELECT item_id, observed_at, lag(observed_at) OVER (PARTITION BY item_id // 5 ORDER BY observed_at, item_id) AS before FROM item)""")
def g9_time_proximity(spark, sf_dir):
    at = F.col("observed_at").cast("timestamp").cast("double")
    rows = _stories(items(spark, sf_dir)).select("item_id", "story_id", at.alias("at"))
    apart = F.col("at") - F.lag("at").over(W.partitionBy("story_id").orderBy("at", "item_id"))
    near = F.when(apart.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - apart / 259200.0))
    return rows.select("item_id", F.round(near, 6).alias("proximity"))


@query(f"""WITH {SQL} SELECT item_id, concat_ws(' · ', substr(trim(title), 1, 160), source_id, {_DAY}, array_to_string(list_filter([CASE WHEN item_id % 2 = 0 THEN 'Part ' || (item_id % 3) END, CASE WHEN item_id % 4 = 0 THEN 'Section ' || (item_id % 5) END, CASE WHEN item_id % 8 = 0 THEN 'Notes' END, CASE WHEN item_id % 16 = 0 THEN 'Last' END], lambda x: x IS NOT NULL)[-3:], ' › ')) || chr(10) || chr(10) || trim(body) AS header FROM item""")
def g18_context_header(spark, sf_dir):
    """What is indexed: title, source, day and the last three headings (here: made from the number) before the whole text."""
    k = F.col("item_id")
    headings = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(F.lit("Part "), (k % 3).cast("string"))), F.when(k % 4 == 0, F.concat(F.lit("Section "), (k % 5).cast("string"))), F.when(k % 8 == 0, "Notes"), F.when(k % 16 == 0, "Last")))
    last = F.array_join(F.slice(headings, F.greatest(F.lit(1), F.size(headings) - 2), 3), " › ")
    return _with_day(items(spark, sf_dir)).select("item_id", F.concat(F.concat_ws(" · ", F.substring(F.trim("title"), 1, 160), "source_id", "day", last), F.lit("\n\n"), F.trim("body")).alias("header"))


@query(f"""WITH {SQL}, e AS (SELECT {_DAY} AS day, item_id, title, source_id, {_SECTION} AS section, {_ORDER} AS place FROM item QUALIFY row_number() OVER (PARTITION BY {_DAY} ORDER BY item_id) <= 12), o AS (SELECT item_id // 5 AS story, count(DISTINCT source_id) AS n FROM item GROUP BY 1),
l AS (SELECT day, place, section, string_agg('- **[' || title || '](https://example.com/' || item_id || ')** · ' || source_id || CASE WHEN n > 1 THEN ' · +' || (n - 1) ELSE '' END, chr(10) ORDER BY item_id) AS lines FROM e JOIN o ON story = item_id // 5 GROUP BY ALL)
SELECT day, '# ' || day || chr(10) || string_agg('## ' || section || chr(10) || lines, chr(10) ORDER BY place) AS body FROM l GROUP BY day""")
def g23_render_report(spark, sf_dir):
    """Markdown of each day's first twelve items (a report's size) by section, with how many other sources have the story."""
    kind = F.col("content_type")
    section, place = _mapped(kind, {x: x for x in SECTIONS}, F.lit("other")), _mapped(kind, {x: k for k, x in enumerate(SECTIONS)}, F.lit(len(SECTIONS)))
    rows = _with_day(items(spark, sf_dir)).select("day", "item_id", "title", "source_id", section.alias("section"), place.alias("place"), F.floor(F.col("item_id") / 5).alias("story"))
    outlets = rows.groupBy("story").agg(F.countDistinct("source_id").alias("n"))
    kept = rows.withColumn("r", F.row_number().over(W.partitionBy("day").orderBy("item_id"))).filter("r <= 12").join(outlets, "story")
    entry = F.concat(F.lit("- **["), "title", F.lit("](https://example.com/"), F.col("item_id").cast("string"), F.lit(")** · "), "source_id", F.when(F.col("n") > 1, F.concat(F.lit(" · +"), (F.col("n") - 1).cast("string"))).otherwise(""))
    joined = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("entry")))), lambda s: s["entry"]), "\n")
    sections = kept.groupBy("day", "place", "section").agg(joined("item_id", entry).alias("lines"))
    return sections.groupBy("day").agg(joined("place", F.concat(F.lit("## "), "section", F.lit("\n"), "lines")).alias("text")).select("day", F.concat(F.lit("# "), "day", F.lit("\n"), "text").alias("body"))


@query(f"""WITH {SQL} SELECT item_id, {_DAY} || '-' || substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) || '-' || substr(sha256(title), 1, 8) AS slug FROM item""")
def g24_slug(spark, sf_dir):
    stem = F.substring(F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60)
    return _with_day(items(spark, sf_dir)).select("item_id", F.concat_ws("-", "day", stem, F.substring(F.sha2("title", 256), 1, 8)).alias("slug"))
