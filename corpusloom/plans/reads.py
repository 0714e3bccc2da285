"""Relational reads over items, passages, sources and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import pages
from corpusloom.operators.ranks import ranked
from corpusloom.plans.registry import query
from corpusloom.sources.tables import CONTENT_TYPES, SQL, ZONE, items, passages, read_tables, sources

_DAY = f"CAST(CAST(timezone('{ZONE}', timezone('UTC', coalesce(published_at, observed_at))) AS DATE) AS VARCHAR)"


def _with_day(rows):
    at = F.coalesce("published_at", "observed_at").cast("timestamp")
    return rows.withColumn("day", F.to_date(F.from_utc_timestamp(at, ZONE)).cast("string"))


@query(f"WITH {SQL} SELECT i.item_id, i.title, i.body, i.source_id, s.tier, s.organization, i.content_type, i.quality, strftime(i.observed_at, '%Y-%m-%d %H:%M:%S') AS observed_at, strftime(i.published_at, '%Y-%m-%d %H:%M:%S') AS published_at, (SELECT count(*) FROM passage p WHERE p.item_id = i.item_id) AS passages FROM item i JOIN source s USING (source_id)")
def a1_read_tables(spark, sf_dir):
    """Items with their sources and how many passages they have: all that the other plans read."""
    counts = passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("passages"))
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir)), "source_id").join(counts, "item_id", "left")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("item_id", "title", "body", "source_id", "tier", "organization", "content_type", "quality", at("observed_at"), at("published_at"), F.coalesce("passages", F.lit(0)).alias("passages"))


_HEADED = """replace(html, '</head>', CASE page_id % 4 WHEN 0 THEN '<link rel="canonical" href="https://example.com/c/' || page_id || '">' WHEN 1 THEN '<meta property="og:url" content="https://example.com/o/' || page_id || '">' ELSE '' END
  || CASE page_id % 3 WHEN 0 THEN '<meta property="og:title" content="Shared title ' || page_id || '">' ELSE '' END || CASE page_id % 5 WHEN 0 THEN '<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2024-01-0' || (page_id % 9 + 1) || 'T08:00:00Z"}</script>' ELSE '' END || '</head>')"""


@query(f"""WITH h AS (SELECT page_id, url, {_HEADED} AS html FROM pages), p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style|nav)[^>]*>.*?</(?:script|style|nav)>', ' ', 'g'), '(?s)<!--.*?-->|<div class="ad">.*?</div>', ' ', 'g'), '(?s)^.*?<body[^>]*>', '') AS main FROM h)
SELECT page_id, coalesce(nullif(regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<meta property="og:url" content="([^"]*)"', 1), ''), url) AS canonical,
  trim(coalesce(nullif(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1), ''), regexp_extract(html, '<title>([^<]*)</title>', 1))) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
  nullif(regexp_extract(html, '"datePublished":"([^"]*)"', 1), '') AS published, md5(trim(regexp_replace(regexp_replace(main, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_md5,
  CAST(length(array_to_string(list_transform(regexp_extract_all(html, '(?s)<a [^>]*>(.*?)</a>', 1), lambda x: regexp_replace(x, '<[^>]+>', '', 'g')), '')) AS BIGINT) AS link_chars FROM p""")
def a3_page_titles(spark, sf_dir):
    """What a page says of itself: canonical address, title, language, date of its JSON-LD, its text without marks,
    menus and advertisements, and how many characters its links have. (Some pages are given such heads first.)"""
    (pages,) = read_tables(spark, sf_dir, "pages")
    k, word = F.col("page_id"), F.col("page_id").cast("string")
    head = F.concat(
        F.when(k % 4 == 0, F.concat(F.lit('<link rel="canonical" href="https://example.com/c/'), word, F.lit('">'))).when(k % 4 == 1, F.concat(F.lit('<meta property="og:url" content="https://example.com/o/'), word, F.lit('">'))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit('<meta property="og:title" content="Shared title '), word, F.lit('">'))).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2024-01-0'), (k % 9 + 1).cast("string"), F.lit('T08:00:00Z"}</script>'))).otherwise(""), F.lit("</head>"),
    )
    rows = pages.select("page_id", "url", F.replace(F.col("html"), F.lit("</head>"), head).alias("html"))
    told = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    main = F.regexp_replace("html", r"(?s)<(?:script|style|nav)[^>]*>.*?</(?:script|style|nav)>", " ")
    main = F.regexp_replace(F.regexp_replace(main, r'(?s)<!--.*?-->|<div class="ad">.*?</div>', " "), r"(?s)^.*?<body[^>]*>", "")
    links = F.transform(F.regexp_extract_all("html", F.lit(r"(?s)<a [^>]*>(.*?)</a>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]+>", ""))
    return rows.select(
        "page_id", F.coalesce(told('<link rel="canonical" href="([^"]*)"'), told('<meta property="og:url" content="([^"]*)"'), "url").alias("canonical"), F.trim(F.coalesce(told('<meta property="og:title" content="([^"]*)"'), F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"), told('"datePublished":"([^"]*)"').alias("published"), F.md5(F.trim(F.regexp_replace(F.regexp_replace(main, "<[^>]+>", " "), r"\s+", " "))).alias("body_md5"), F.length(F.array_join(links, "")).cast("long").alias("link_chars"),
    )


_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"


@query(f"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), a AS (SELECT page_id, {_HOST} AS host, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(href, '^([^?#]*)', 1) WHEN regexp_matches(href, '^https?://') THEN regexp_extract(href, '^([^?#]*)', 1) END AS link FROM l)
SELECT page_id, link, count(*) AS n FROM a WHERE link IS NOT NULL AND lower(regexp_extract(link, '^https?://([^/?#]*)', 1)) = host AND length(regexp_extract(link, '^https?://[^/]*/(.*)$', 1)) > 2 AND NOT regexp_matches(lower(link), '/(tags?|categor(y|ies)|author|page)/|/(search|login|signup|pricing|careers|contact|privacy|terms|rss|feed|about)') GROUP BY page_id, link""")
def a4_extract_links(spark, sf_dir):
    """Links of a page that may lead to articles: absolute, of the same host, below its root, to no menu page."""
    (pages,) = read_tables(spark, sf_dir, "pages")
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    bare = F.regexp_extract("href", "^([^?#]*)", 1)
    link = F.when(F.col("href").startswith("/"), F.concat(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), bare)).when(F.col("href").rlike("^https?://"), bare)
    host = lambda c: F.lower(F.regexp_extract(c, "^https?://([^/?#]*)", 1))
    menu = "/(tags?|categor(y|ies)|author|page)/|/(search|login|signup|pricing|careers|contact|privacy|terms|rss|feed|about)"
    found = links.select("page_id", "url", link.alias("link")).filter((host("link") == host("url")) & (F.length(F.regexp_extract("link", "^https?://[^/]*/(.*)$", 1)) > 2) & ~F.lower("link").rlike(menu))
    return found.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query()
def a3_parse_pages(spark, sf_dir):
    """Articles of all pages: address, title, language, date, main text and how much of it is links."""
    (rows,) = read_tables(spark, sf_dir, "pages")
    return pages.articles(rows)


@query()
def a4_article_links(spark, sf_dir):
    """Addresses of articles that pages name, in their JSON-LD or by links in any form."""
    (rows,) = read_tables(spark, sf_dir, "pages")
    return pages.article_links(rows)


_FIRST = "SELECT *, min(item_id) OVER (PARTITION BY body) AS canonical_id FROM item"


def with_canonical(rows):
    """The smallest item of equal bodies: by digest, so that hot copies are summed before the shuffle."""
    keyed = rows.withColumn("body_key", F.sha2("body", 256))
    first = keyed.groupBy("body_key").agg(F.min("item_id").alias("canonical_id"))
    return keyed.join(first, "body_key").drop("body_key")


_KEYS = """keyed AS (SELECT item_id, 'x' || (CASE WHEN item_id % 10 = 9 THEN item_id - 1 ELSE item_id END) AS external, 'https://example.com/' || (CASE WHEN item_id % 15 = 14 THEN item_id - 2 ELSE item_id END) AS url, sha256(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS content FROM item)"""


@query(f"""WITH {SQL}, {_KEYS}, m AS (SELECT item_id, min(item_id) OVER (PARTITION BY external) AS e, min(item_id) OVER (PARTITION BY url) AS u, min(item_id) OVER (PARTITION BY content) AS c FROM keyed)
SELECT item_id, least(e, u, c) AS canonical_id, CASE WHEN e < item_id THEN 'external_id' WHEN u < item_id THEN 'url' WHEN c < item_id THEN 'content' END AS kind FROM m""")
def i1_exact_duplicates(spark, sf_dir):
    """The earliest item with the same external id, canonical address or normalised text (some of the first two are made equal)."""
    k = F.col("item_id")
    rows = items(spark, sf_dir).select(
        "item_id", F.concat(F.lit("x"), F.when(k % 10 == 9, k - 1).otherwise(k).cast("string")).alias("external"), F.concat(F.lit("https://example.com/"), F.when(k % 15 == 14, k - 2).otherwise(k).cast("string")).alias("url"),
        F.sha2(F.trim(F.regexp_replace("body", r"\s+", " ")), 256).alias("content"),
    )
    keyed = rows.select("item_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).alias("key")) for n, c in (("e", "external"), ("u", "url"), ("c", "content"))])).alias("x")).select("item_id", "x.*")
    first = keyed.groupBy("kind", "key").agg(F.min("item_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only what shares a key with another is joined back
    told = keyed.join(first, ["kind", "key"]).groupBy("item_id").agg(*[F.min(F.when(F.col("kind") == n, F.col("first"))).alias(n) for n in "euc"])
    rows = rows.select("item_id").join(told, "item_id", "left").select("item_id", *[F.coalesce(n, "item_id").alias(n) for n in "euc"])
    kind = F.when(F.col("e") < k, "external_id").when(F.col("u") < k, "url").when(F.col("c") < k, "content")
    return rows.select("item_id", F.least("e", "u", "c").alias("canonical_id"), kind.alias("kind"))


@query(f"""WITH {SQL}, f AS ({_FIRST}) SELECT f.item_id, p.ordinal, s.tier, f.content_type FROM passage p JOIN f USING (item_id) JOIN source s USING (source_id) WHERE f.canonical_id = f.item_id""")
def c1_current_chunks(spark, sf_dir):
    live = with_canonical(items(spark, sf_dir)).filter("canonical_id = item_id").select("item_id", "source_id", "content_type")
    found = passages(spark, sf_dir).select("item_id", "ordinal").join(live, "item_id")
    return found.join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier")), "source_id").select("item_id", "ordinal", "tier", "content_type")


@query(f"""WITH {SQL} SELECT i.item_id, s.organization, count(p.ordinal) AS passages FROM item i LEFT JOIN source s ON s.source_id = i.source_id AND s.tier <> 'community' LEFT JOIN passage p ON p.item_id = i.item_id GROUP BY i.item_id, s.organization""")
def c2_left_outer_enrichment(spark, sf_dir):
    counts = passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("passages"))
    outlets = F.broadcast(sources(spark, sf_dir).filter("tier <> 'community'").select("source_id", "organization"))
    rows = items(spark, sf_dir).select("item_id", "source_id").join(outlets, "source_id", "left").join(counts, "item_id", "left")
    return rows.select("item_id", "organization", F.coalesce("passages", F.lit(0)).alias("passages"))


@query(f"WITH {SQL} SELECT item_id FROM item i WHERE NOT EXISTS (SELECT 1 FROM passage p WHERE p.item_id = i.item_id) AND length(trim(body)) > 0")
def c3_unchunked(spark, sf_dir):
    return items(spark, sf_dir).filter(F.length(F.trim("body")) > 0).select("item_id").join(passages(spark, sf_dir).select("item_id"), "item_id", "left_anti")


@query(f"WITH {SQL} SELECT item_id, content_type FROM item i WHERE EXISTS (SELECT 1 FROM passage p WHERE p.item_id = i.item_id AND length(p.passage) > 1200)")
def c17_rechunk_targets(spark, sf_dir):
    large = passages(spark, sf_dir).filter(F.length("passage") > 1200).select("item_id")
    return items(spark, sf_dir).select("item_id", "content_type").join(large, "item_id", "left_semi")


@query(f"""WITH {SQL} SELECT p.item_id, p.ordinal, concat_ws(' · ', i.title, i.source_id, {_DAY.replace("published_at", "i.published_at").replace("observed_at", "i.observed_at")}) AS header, CASE WHEN e.vec_id IS NULL THEN 'missing' ELSE 'other_model' END AS reason
  FROM passage p JOIN item i USING (item_id) LEFT JOIN embeddings e ON e.vec_id = p.item_id WHERE e.vec_id IS NULL OR e.label % 3 > 0""")
def c14_pending_embeddings(spark, sf_dir):
    """Passages without a vector of the current model (here: those with label mod 3 = 0), each with its context header."""
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    known = vectors.select(F.col("vec_id").alias("item_id"), (F.col("label") % 3 > 0).alias("other"))
    facts = _with_day(items(spark, sf_dir)).select("item_id", F.concat_ws(" · ", "title", "source_id", "day").alias("header"))
    rows = passages(spark, sf_dir).select("item_id", "ordinal").join(known, "item_id", "left").filter(F.col("other").isNull() | F.col("other")).join(facts, "item_id")
    return rows.select("item_id", "ordinal", "header", F.when(F.col("other"), "other_model").otherwise("missing").alias("reason"))


@query(f"""WITH {SQL} SELECT (SELECT count(*) FROM item) AS items, (SELECT count(*) FROM item WHERE quality IS NOT NULL) AS enriched, (SELECT count(*) FROM source) AS sources, (SELECT count(*) FROM passage) AS passages,
 (SELECT strftime(min(observed_at), '%Y-%m-%d') FROM item) AS first_day, (SELECT strftime(max(observed_at), '%Y-%m-%d') FROM item) AS last_day""")
def d1_corpus_stats(spark, sf_dir):
    first = lambda f: F.date_format(f("observed_at"), "yyyy-MM-dd")
    rows = items(spark, sf_dir).agg(F.count("*").alias("items"), F.count("quality").alias("enriched"), first(F.min).alias("first_day"), first(F.max).alias("last_day"))
    return rows.crossJoin(sources(spark, sf_dir).agg(F.count("*").alias("sources"))).crossJoin(passages(spark, sf_dir).agg(F.count("*").alias("passages")))


@query(f"WITH {SQL} SELECT source_id, count(*) AS n FROM item GROUP BY source_id ORDER BY n DESC, source_id LIMIT 8")
def d2_top_sources(spark, sf_dir):
    return items(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id").limit(8)


@query(f"WITH {SQL}, t AS (SELECT unnest({CONTENT_TYPES + ['unused_type']}) AS content_type) SELECT t.content_type, count(i.item_id) AS n FROM t LEFT JOIN item i ON i.content_type = t.content_type AND i.quality IS NOT NULL GROUP BY t.content_type UNION ALL SELECT 'all', count(*) FROM item WHERE quality IS NOT NULL")
def d3_category_counts(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in CONTENT_TYPES + ["unused_type"]], "content_type string")
    counts = items(spark, sf_dir).filter("quality is not null").groupBy("content_type").agg(F.count("*").alias("n"))
    whole = counts.agg(F.lit("all").alias("content_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return kinds.join(counts, "content_type", "left").select("content_type", F.coalesce("n", F.lit(0)).alias("n")).union(whole)


@query(f"WITH {SQL} SELECT {_DAY} AS day, count(*) AS n FROM item GROUP BY 1")
def d4_day_counts(spark, sf_dir):
    return _with_day(items(spark, sf_dir)).groupBy("day").agg(F.count("*").alias("n"))


@query(f"WITH {SQL} SELECT content_type, source_id, count(*) AS items, count(DISTINCT CASE WHEN quality >= 50 THEN item_id END) AS good FROM item GROUP BY content_type, source_id HAVING count(*) > 1")
def d5_topic_map(spark, sf_dir):
    found = items(spark, sf_dir).groupBy("content_type", "source_id").agg(F.count("*").alias("items"), F.countDistinct(F.when(F.col("quality") >= 50, F.col("item_id"))).alias("good"))
    return found.filter("items > 1")


@query(f"WITH {SQL} SELECT s.organization, count(DISTINCT i.item_id) FILTER (WHERE s.tier = 'primary') AS primary_items, count(DISTINCT i.item_id) FILTER (WHERE i.observed_at >= TIMESTAMP '2024-01-24') AS recent FROM item i JOIN source s USING (source_id) GROUP BY s.organization")
def d6_vendor_map(spark, sf_dir):
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir)), "source_id")
    recent = F.col("observed_at").cast("timestamp") >= F.lit("2024-01-24").cast("timestamp")
    return rows.groupBy("organization").agg(F.countDistinct(F.when(F.col("tier") == "primary", F.col("item_id"))).alias("primary_items"), F.countDistinct(F.when(recent, F.col("item_id"))).alias("recent"))


@query(f"WITH {SQL} SELECT i.content_type, count(DISTINCT coalesce(s.organization, i.source_id)) AS outlets FROM item i LEFT JOIN source s USING (source_id) GROUP BY i.content_type")
def d15_independent_sources(spark, sf_dir):
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir)), "source_id", "left")
    return rows.groupBy("content_type").agg(F.countDistinct(F.coalesce("organization", "source_id")).alias("outlets"))


@query("SELECT conv_id, min_by(text, turn) FILTER (WHERE role = 'user') AS first_question, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def d18_thread_list(spark, sf_dir):
    (turns,) = read_tables(spark, sf_dir, "conversations")
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conv_id").agg(first.alias("first_question"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


@query('''SELECT conv_id, '[' || coalesce(string_agg('{"turn":' || turn || ',"role":"' || role || '","chars":' || length(text) || '}', ',' ORDER BY turn) FILTER (WHERE role <> 'system'), '') || ']' AS turns FROM conversations GROUP BY conv_id''')
def d19_conversation_json(spark, sf_dir):
    """Each conversation's turns as a JSON array in order; without the system's, which may leave it empty."""
    (turns,) = read_tables(spark, sf_dir, "conversations")
    entry = F.when(F.col("role") != "system", F.struct("turn", "role", F.length("text").alias("chars")))
    return turns.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("turns"))


@query('''WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), c AS (SELECT conv_id, turn, unnest([(conv_id * 7 + turn) % 50, (conv_id + turn * 3) % 50, conv_id % 50, turn % 50]) AS doc_id FROM r WHERE r <= 6),
t AS (SELECT c.conv_id, c.turn, list_sort(list(DISTINCT split_part(d.text, '.', 1)))[1:3] AS titles FROM c JOIN documents d USING (doc_id) GROUP BY ALL)
SELECT r.conv_id, r.turn, role, array_to_string(titles, '|') AS titles, row_number() OVER (PARTITION BY r.conv_id ORDER BY r.turn) AS place FROM r LEFT JOIN t USING (conv_id, turn) WHERE r <= 6''')
def h19_load_turns(spark, sf_dir):
    """The last six turns of each conversation, oldest first, with at most three of the titles they cite (here: of four documents by number)."""
    turns, docs = read_tables(spark, sf_dir, "conversations", "documents")
    last = turns.withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r <= 6").select("conv_id", "turn", "role")
    cited = F.array((F.col("conv_id") * 7 + F.col("turn")) % 50, (F.col("conv_id") + F.col("turn") * 3) % 50, F.col("conv_id") % 50, F.col("turn") % 50)
    titles = docs.select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    told = last.select("conv_id", "turn", F.explode(cited).alias("doc_id")).join(titles, "doc_id").groupBy("conv_id", "turn").agg(F.array_join(F.slice(F.sort_array(F.collect_set("title")), 1, 3), "|").alias("titles"))
    return last.join(told, ["conv_id", "turn"], "left").withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long"))


@query(f"WITH {SQL} SELECT item_id, ordinal, length(passage) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ordinal) AS r FROM passage) WHERE r = 1")
def e2_first_chunk(spark, sf_dir):
    found = passages(spark, sf_dir).groupBy("item_id").agg(F.min_by(F.struct("ordinal", F.length("passage").alias("chars")), "ordinal").alias("first"))
    return found.select("item_id", "first.ordinal", F.col("first.chars").cast("long").alias("chars"))


_TOPICS = "labelled AS (SELECT item_id, topic, CASE WHEN length(topic) % 4 > 0 THEN round(0.4e0 + (length(topic) * 7 + item_id) % 60 / 100e0, 2) END AS confidence FROM (SELECT DISTINCT item_id, unnest(string_split(lower(title), ' ')) AS topic FROM item) WHERE topic <> '')"


def labelled(spark, sf_dir):
    """item_id, topic, confidence: the words of a title stand for its topics, some without a confidence."""
    words = F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("topic")
    size = F.length("topic")
    return items(spark, sf_dir).select("item_id", words).filter("topic <> ''").withColumn("confidence", F.when(size % 4 > 0, F.round(0.4 + (size * 7 + F.col("item_id")) % 60 / 100.0, 2)))


@query(f"WITH {SQL}, {_TOPICS} SELECT item_id, topic, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC NULLS LAST, topic) AS r FROM labelled WHERE confidence >= 0.6) WHERE r <= 3")
def e1_top_per_topic(spark, sf_dir):
    """The three topics of an item that are surest, from 0.60 on."""
    order = W.partitionBy("item_id").orderBy(F.desc_nulls_last("confidence"), "topic")
    return labelled(spark, sf_dir).filter("confidence >= 0.6").withColumn("r", F.row_number().over(order)).filter("r <= 3").drop("r")


@query(f"""WITH {SQL}, r AS (SELECT item_id, row_number() OVER (ORDER BY observed_at DESC, item_id DESC) AS r FROM item), p AS (SELECT c.item_id AS cursor, i.item_id, i.r - c.r AS place FROM r c JOIN r i ON i.r BETWEEN c.r + 1 AND c.r + 21 WHERE c.item_id % 20 = 0)
SELECT cursor, item_id, place, max(place) OVER (PARTITION BY cursor) > 20 AS has_more FROM p QUALIFY place <= 20""")
def e4_keyset_page(spark, sf_dir):
    """The page of twenty behind each cursor (every twentieth item) in order of time, and whether more follow."""
    placed = ranked(items(spark, sf_dir).select("item_id", (-F.unix_micros(F.col("observed_at").cast("timestamp"))).alias("at"), (-F.col("item_id")).alias("no")), [], ["at", "no"])
    cursors = placed.filter("item_id % 20 = 0").select(F.col("item_id").alias("cursor"), F.explode(F.sequence(F.lit(1), F.lit(21))).alias("place"), F.col("r").alias("c"))
    page = cursors.join(placed, placed.r == F.col("c") + F.col("place")).select("cursor", "item_id", F.col("place").cast("long").alias("place"))
    more = page.groupBy("cursor").agg((F.max("place") > 20).alias("has_more"))
    return page.filter("place <= 20").join(more, "cursor")


@query(f"""WITH {SQL}, o AS (SELECT 'curated' AS sort, item_id, row_number() OVER (ORDER BY quality DESC NULLS LAST, item_id) AS place FROM item UNION ALL SELECT 'heat', item_id, row_number() OVER (ORDER BY CASE WHEN item_id % 3 > 0 THEN length(body) END DESC NULLS LAST, item_id) FROM item
  UNION ALL SELECT 'latest', item_id, row_number() OVER (ORDER BY coalesce(published_at, observed_at) DESC, item_id) FROM item) SELECT * FROM o WHERE place <= 50""")
def e5_selected_feed(spark, sf_dir):
    """The first fifty (a page's size) of the selected items in each of three orders; heat is null for a third."""
    rows = items(spark, sf_dir).select("item_id", "quality", F.when(F.col("item_id") % 3 > 0, F.length("body")).alias("heat"), F.coalesce("published_at", "observed_at").alias("at"))
    out = None
    for name, order in (("curated", F.desc_nulls_last("quality")), ("heat", F.desc_nulls_last("heat")), ("latest", F.desc("at"))):
        top = rows.orderBy(order, "item_id").limit(50).select(F.lit(name).alias("sort"), "item_id", F.row_number().over(W.orderBy(order, "item_id")).cast("long").alias("place"))
        out = top if out is None else out.union(top)
    return out


@query(f"WITH {SQL} SELECT 'vendor' AS kind, organization AS target FROM source UNION ALL SELECT 'topic', content_type FROM (SELECT DISTINCT content_type FROM item)")
def f1_union_targets(spark, sf_dir):
    vendors = sources(spark, sf_dir).select(F.lit("vendor").alias("kind"), F.col("organization").alias("target"))
    return vendors.unionByName(items(spark, sf_dir).select(F.lit("topic").alias("kind"), F.col("content_type").alias("target")).distinct())


@query(f"""WITH {SQL}, old AS (SELECT item_id, published_at, 'old ' || item_id AS reason, CASE WHEN item_id % 5 = 0 THEN 'v1' END AS reason_version, CASE WHEN content_type = 'policy' THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS status FROM item WHERE item_id % 3 <> 0), new AS (SELECT item_id, CASE WHEN item_id % 4 <> 0 THEN observed_at END AS published_at, 'new ' || item_id AS reason FROM item WHERE item_id % 3 <> 1)
SELECT item_id, strftime(coalesce(new.published_at, old.published_at), '%Y-%m-%d') AS published, CASE WHEN reason_version IS NOT NULL THEN old.reason ELSE coalesce(new.reason, old.reason) END AS reason, CASE WHEN status = 'WITHDRAWN' THEN status ELSE 'ACTIVE' END AS status FROM old FULL JOIN new USING (item_id)""")
def f4_upsert_latest(spark, sf_dir):
    """New rows over old ones: a missing new time keeps the old one, a written reason stays, what is withdrawn stays so."""
    rows, k = items(spark, sf_dir), F.col("item_id")
    old = rows.filter("item_id % 3 <> 0").select("item_id", F.col("published_at").alias("old_at"), F.concat(F.lit("old "), k.cast("string")).alias("old_reason"), F.when(k % 5 == 0, "v1").alias("version"), F.when(F.col("content_type") == "policy", "WITHDRAWN").otherwise("ACTIVE").alias("old_status"))
    new = rows.filter("item_id % 3 <> 1").select("item_id", F.when(k % 4 != 0, F.col("observed_at")).alias("new_at"), F.concat(F.lit("new "), k.cast("string")).alias("new_reason"))
    return old.join(new, "item_id", "full").select(
        "item_id", F.date_format(F.coalesce("new_at", "old_at"), "yyyy-MM-dd").alias("published"), F.when(F.col("version").isNotNull(), F.col("old_reason")).otherwise(F.coalesce("new_reason", "old_reason")).alias("reason"), F.when(F.col("old_status") == "WITHDRAWN", "WITHDRAWN").otherwise("ACTIVE").alias("status")
    )


@query(f"""WITH {SQL}, r AS (SELECT source_id, sha256(title) AS sha, min(item_id) AS first_item FROM item GROUP BY source_id, sha256(title)), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY first_item) AS revision_no FROM r)
SELECT source_id, sha, revision_no, revision_no = max(revision_no) OVER (PARTITION BY source_id) AS current, revision_no > 1 AND first_item % 6 > 0 AS reopened FROM n""")
def f5_revise(spark, sf_dir):
    """A revision for each new text of a source, numbered as they come; the last is current, and a later one opens its
    item again unless that is a copy (here: every sixth)."""
    seen = items(spark, sf_dir).groupBy("source_id", F.sha2("title", 256).alias("sha")).agg(F.min("item_id").alias("first_item"))
    rows = ranked(seen, ["source_id"], ["first_item"], "revision_no")
    last = rows.groupBy("source_id").agg(F.max("revision_no").alias("last"))
    rows = rows.join(F.broadcast(last), "source_id")  # a row a source
    return rows.select("source_id", "sha", "revision_no", (F.col("revision_no") == F.col("last")).alias("current"), ((F.col("revision_no") > 1) & (F.col("first_item") % 6 > 0)).alias("reopened"))
