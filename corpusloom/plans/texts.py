"""Queries of the scalar text rules and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import scores, text
from corpusloom.plans.registry import query
from corpusloom.sources.tables import NOW, SQL, ZONE, items, read_tables

_IN = "'" + "','".join(text.TRACKING) + "'"


_ODD = "CASE page_id % 6 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'b=%41+c&a&z=1*2~&UTM_x=1&b=%2F' WHEN 2 THEN 'ftp://example.com/x' WHEN 3 THEN '  ' || upper(split_part(url, ':', 1)) || '://' ELSE url END"
_PART = "replace(replace(url_decode(replace({}, '+', ' ')), chr(0), ''), '', '')"
_ENC = "replace(url_encode({}), '%20', '+')"


@query(f"""WITH o AS (SELECT page_id, trim({_ODD}) AS url FROM pages), u AS (SELECT page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^.*@', '')) AS place, coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), ''), '/') AS path,
  list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> ''), lambda p: {{'k': {_PART.format("regexp_extract(p, '^([^=]*)', 1)")}, 'v': {_PART.format("regexp_extract(p, '^[^=]*=(.*)$', 1)")}}}),
    lambda p: lower(p.k) NOT IN ({_IN}) AND NOT starts_with(lower(p.k), 'utm_'))) AS q FROM o),
c AS (SELECT page_id, CASE WHEN scheme <> '' AND place <> '' THEN scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(place, ':80$', '') ELSE regexp_replace(place, ':443$', '') END || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda p: {_ENC.format("p.k")} || '=' || {_ENC.format("p.v")}), '&') ELSE '' END END AS canonical FROM u)
SELECT page_id, canonical, sha256(canonical) AS url_hash FROM c""")
def b1_canonicalize_url(spark, sf_dir):
    """Identity of URLs; some are given users, odd parameters or other schemes first."""
    (pages,) = read_tables(spark, sf_dir, "pages")
    k, url = F.col("page_id") % 6, F.col("url")
    more = F.concat(F.split_part(url, F.lit("#"), F.lit(1)), F.when(url.contains("?"), "&").otherwise("?"), F.lit("b=%41+c&a&z=1*2~&UTM_x=1&b=%2F"))
    odd = F.when(k == 0, F.replace(url, F.lit("://"), F.lit("://user:pw@"))).when(k == 1, more).when(k == 2, "ftp://example.com/x").when(k == 3, F.concat(F.lit("  "), F.upper(F.split_part(url, F.lit(":"), F.lit(1))), F.lit("://"))).otherwise(url)
    canonical = text.canonical_url(odd)
    return pages.select("page_id", canonical.alias("canonical"), F.sha2(canonical, 256).alias("url_hash"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_sha256 FROM documents")
def b2_content_hash(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.content_hash(F.col("text")).alias("content_sha256"))


@query(f"""WITH {SQL}, c AS (SELECT item_id, trim(body) AS b, item_id % 9 = 0 AS release, published_at, (item_id % 50) / 100.0 * length(body) AS links,
 len(list_filter(string_split(trim(body), chr(10)), lambda p: length(trim(p)) >= 40)) AS paragraphs,
 CASE WHEN length(title) > 0 THEN 1 ELSE 0 END + CASE WHEN item_id % 11 = 0 THEN 0 ELSE 1 END + CASE WHEN published_at IS NULL THEN 0 ELSE 1 END + 1 AS present FROM item)
SELECT item_id, CASE WHEN length(b) = 0 THEN 'EMPTY_BODY' WHEN contains(lower(b), 'enable javascript') OR contains(lower(b), 'sign in to continue') OR contains(lower(b), 'access denied') OR contains(lower(b), 'verify you are human') THEN 'BLOCKED_PAGE'
 WHEN length(b) < CASE WHEN release THEN 80 ELSE 300 END THEN 'BODY_TOO_SHORT' WHEN NOT release AND paragraphs < 2 THEN 'TOO_FEW_PARAGRAPHS'
 WHEN NOT release AND links / length(b) > 0.35 THEN 'LINK_DENSITY' WHEN present < 3 THEN 'INSUFFICIENT_METADATA' ELSE 'ACCEPTED' END AS decision FROM c""")
def b3_fulltext_gate(spark, sf_dir):
    rows = items(spark, sf_dir)
    url = F.when(F.col("item_id") % 11 != 0, F.concat(F.lit("https://example.com/"), F.col("item_id")))
    links = (F.col("item_id") % 50) / 100.0 * F.length("body")
    gate = text.fulltext_gate(F.col("body"), F.col("title"), url, F.col("published_at"), F.col("source_id"), links, F.col("item_id") % 9 == 0)
    return rows.select("item_id", gate.alias("decision"))


@query(f"""WITH {SQL} SELECT item_id, CAST(round(CASE WHEN item_id % 5 <> 0 THEN greatest(0.0, least(0.9999, 0.5 + 0.5 * least(length(body) / 4000.0, 1.0) - greatest((item_id % 50) / 100.0 - 0.1, 0.0))) ELSE 0.0 END, 6) AS DOUBLE) AS score FROM item""")
def b6_gate_quality_score(spark, sf_dir):
    score = scores.gate_quality(F.col("item_id") % 5 != 0, F.length("body"), (F.col("item_id") % 50) / 100.0)
    return items(spark, sf_dir).select("item_id", F.round(score, 6).alias("score"))


@query(f"""WITH {SQL} SELECT item_id, CAST(CAST(timezone('{ZONE}', timezone('UTC', coalesce(published_at, observed_at))) AS DATE) AS VARCHAR) AS day FROM item""")
def b12_local_day(spark, sf_dir):
    at = F.coalesce("published_at", "observed_at").cast("timestamp")
    return items(spark, sf_dir).select("item_id", F.to_date(F.from_utc_timestamp(at, ZONE)).cast("string").alias("day"))


@query("""SELECT id, kind, labels FROM (SELECT id, kind, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END,
 CASE WHEN regexp_matches(t, '(?i)\\bAuthorization\\s*:\\s*Bearer\\s+\\S+') THEN 'authorization_header' END, CASE WHEN regexp_matches(t, '\\bsk-[A-Za-z0-9_-]{20,}\\b') THEN 'openai_style_key' END,
 CASE WHEN regexp_matches(t, '\\bgh[pousr]_[A-Za-z0-9]{20,}\\b') THEN 'github_token' END, CASE WHEN regexp_matches(t, '\\bAKIA[0-9A-Z]{16}\\b') THEN 'aws_access_key' END], lambda x: x IS NOT NULL), ',') AS labels
 FROM (SELECT id, kind, t || CASE id % 9 WHEN 0 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 1 THEN ' authorization:  bearer a.b' WHEN 2 THEN ' sk-' || md5(t) WHEN 3 THEN ' ghp_' || md5(t) WHEN 4 THEN ' AKIA' || upper(substr(md5(t), 1, 16)) WHEN 5 THEN ' AKIA123 sk-short xghp_' || md5(t) ELSE '' END AS t FROM (SELECT doc_id AS id, 'document' AS kind, text AS t FROM documents UNION ALL SELECT conv_id, 'turn', text FROM conversations)))""")
def b13_credential_scan(spark, sf_dir):
    """Which kinds of credentials texts hold (some are appended, as the tables hold none)."""
    docs, turns = read_tables(spark, sf_dir, "documents", "conversations")
    both = docs.select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "text").union(turns.select("conv_id", F.lit("turn"), "text"))
    k, digest = F.col("id") % 9, F.md5("text")
    more = F.when(k == 0, " -----BEGIN RSA PRIVATE KEY-----").when(k == 1, " authorization:  bearer a.b").when(k == 2, F.concat(F.lit(" sk-"), digest)).when(k == 3, F.concat(F.lit(" ghp_"), digest))
    more = more.when(k == 4, F.concat(F.lit(" AKIA"), F.upper(F.substring(digest, 1, 16)))).when(k == 5, F.concat(F.lit(" AKIA123 sk-short xghp_"), digest)).otherwise("")
    both = both.withColumn("text", F.concat("text", more))
    return both.select("id", "kind", F.array_join(text.credential_labels(F.col("text")), ",").alias("labels"))


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN text ELSE substr(text, 1, 1300) || chr(10) || '...' || chr(10) || right(text, 700) END AS excerpt FROM documents")
def b16_head_tail_excerpt(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.head_tail(F.col("text"), 2000).alias("excerpt"))


@query("""SELECT doc_id, CAST(CASE WHEN length(text) > 0 THEN greatest(floor((length(text) - length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]', '', 'g'))) / 1.5 + length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}]', '', 'g')) / 4), 1) ELSE 0 END AS BIGINT) AS tokens FROM documents""")
def g1_estimate_tokens(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return docs.select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents)""")
def g5_search_tokens(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    found = docs.select("doc_id", text.search_tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query("SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS question_key FROM conversations WHERE role = 'user'")
def g19_canonical_question(spark, sf_dir):
    (turns,) = read_tables(spark, sf_dir, "conversations")
    return turns.filter("role = 'user'").select("conv_id", "turn", F.sha2(text.canonical_question(F.col("text")), 256).alias("question_key"))


@query(f"""WITH {SQL} SELECT item_id, CAST(isoyear(t) AS VARCHAR) || '-W' || lpad(CAST(week(t) AS VARCHAR), 2, '0') AS week_key, strftime(t, '%Y-%m') AS month_key, strftime(t, '%Y-%m-%d') AS day_key,
 strftime(date_trunc('week', t), '%Y-%m-%d') AS week_start, strftime(last_day(t), '%Y-%m-%d') AS month_end FROM (SELECT item_id, CAST(timezone('{ZONE}', timezone('UTC', observed_at)) AS DATE) AS t FROM item)""")
def g15_period_keys(spark, sf_dir):
    day = F.to_date(F.from_utc_timestamp(F.col("observed_at").cast("timestamp"), ZONE))
    rows = items(spark, sf_dir).select("item_id", day.alias("t"))
    return rows.select(
        "item_id",
        F.concat(F.extract(F.lit("YEAROFWEEK"), "t").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("t").cast("string"), 2, "0")).alias("week_key"),
        F.date_format("t", "yyyy-MM").alias("month_key"),
        F.date_format("t", "yyyy-MM-dd").alias("day_key"),
        F.date_format(F.trunc("t", "week"), "yyyy-MM-dd").alias("week_start"),
        F.date_format(F.last_day("t"), "yyyy-MM-dd").alias("month_end"),
    )


@query(f"""WITH {SQL} SELECT item_id, CASE WHEN moved <= TIMESTAMP '{NOW}' + INTERVAL 6 HOUR AND year(moved) >= 1990 THEN strftime(moved, '%Y-%m-%d') END AS published
 FROM (SELECT item_id, CASE WHEN item_id % 13 = 0 THEN observed_at + INTERVAL 400 DAY WHEN item_id % 17 = 0 THEN observed_at - INTERVAL 20000 DAY ELSE published_at END AS moved FROM item)""")
def b5_sanitize_published_at(spark, sf_dir):
    moved = F.when(F.col("item_id") % 13 == 0, F.expr("observed_at + INTERVAL 400 DAY")).when(F.col("item_id") % 17 == 0, F.expr("observed_at - INTERVAL 20000 DAY")).otherwise(F.col("published_at"))
    rows = items(spark, sf_dir).withColumn("moved", moved)
    limit = F.lit(NOW).cast("timestamp") + F.expr("INTERVAL 6 HOUR")
    sane = (F.col("moved").cast("timestamp") <= limit) & (F.year("moved") >= 1990)
    return rows.select("item_id", F.when(sane, F.date_format("moved", "yyyy-MM-dd")).alias("published"))
