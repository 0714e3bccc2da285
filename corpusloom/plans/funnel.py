"""From candidates to evidence: gates on rows, candidate funnels, folding by story, audits of labels.

Bindings: a query's candidates are those of keyword retrieval; a story is ten adjacent
documents; a second score of a candidate is an event's value.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans.evaluation import _FUSED, _JUDGED, _SPARSE, benchmark_queries, fused, sparse
from corpusloom.plans.registry import query
from corpusloom.sources.tables import CONTENT_TYPES, SQL, items, read_tables, sources

# The content types of each tab.
TABS = {
    "model": ["model_release"],
    "product": ["product_release", "api_update"],
    "industry": ["business", "policy", "security"],
    "paper": ["research"],
    "tutorial": ["tutorial", "open_source"],
    "opinion": ["opinion"],
}
TIER_ORDER = {"primary": 0, "expert": 1, "secondary": 2, "community": 3}
RERANKED, TRACED, PER_STORY, KEPT = 24, 40, 3, 10

_MIX = "mix AS (SELECT query_id, 'sparse' AS channel, doc_id, rank FROM sparse UNION ALL SELECT query_id, 'temporal', doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM sparse) WHERE rank <= 10)"
_RANKED = f"""WITH {_SPARSE}, src AS (SELECT DISTINCT source AS source_id, CAST(substr(source, 4, 10) AS INTEGER) % 4 AS n FROM documents),
ranked AS (SELECT query_id, s.doc_id, s.rank, s.score, d.source AS source_id, CASE n WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS tier_order, s.doc_id // 10 AS story_id FROM sparse s JOIN documents d USING (doc_id) JOIN src ON src.source_id = d.source)"""


def ranked(spark, sf_dir):
    """query_id, doc_id, rank, score, source_id, tier_order and story_id of every candidate."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    tiers = sources(spark, sf_dir)
    order = F.create_map(*[F.lit(v) for pair in TIER_ORDER.items() for v in pair])
    tiers = tiers.select("source_id", order[F.col("tier")].alias("tier_order"))
    found = sparse(spark, sf_dir).join(docs.select("doc_id", F.col("source").alias("source_id")), "doc_id").join(F.broadcast(tiers), "source_id")
    return found.withColumn("story_id", F.floor(F.col("doc_id") / 10))


def channels(spark, sf_dir):
    """The candidates of the keyword channel and of the newest among them."""
    keyword = sparse(spark, sf_dir).select("query_id", F.lit("sparse").alias("channel"), "doc_id", "rank")
    newest = W.partitionBy("query_id").orderBy(F.desc("doc_id"))
    fresh = keyword.select("query_id", F.lit("temporal").alias("channel"), "doc_id", F.row_number().over(newest).alias("rank")).filter("rank <= 10")
    return keyword.unionByName(fresh)


#: a second score of a candidate: the value of the event with its document's id, none for errors
_SECOND = "second AS (SELECT s.*, CASE WHEN e.event_type <> 'error' THEN e.value END AS second FROM sparse s LEFT JOIN events e ON e.event_id = s.doc_id)"


def second_scores(spark, sf_dir):
    """The candidates with a second score, as a model for pairs gives it: here from the table of events."""
    (events,) = read_tables(spark, sf_dir, "events")
    told = events.select(F.col("event_id").alias("doc_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("second"))
    return sparse(spark, sf_dir).join(told, "doc_id", "left")


_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"""WITH {SQL} SELECT item_id, CASE WHEN item_id % 23 = 7 THEN 'json' WHEN item_id % 13 = 11 THEN 'content_type' WHEN item_id % 120 > 100 THEN 'range' WHEN item_id % 17 = 3 THEN 'entities' WHEN item_id % 19 = 5 THEN 'topics' ELSE 'valid' END AS outcome FROM item""")
def b7_validate_enrichment(spark, sf_dir):
    """Structured labels (made from the items, some of them wrong) against their schema: the first fault of each, or valid."""
    k, quote = F.col("item_id"), lambda values: F.concat(F.lit("["), F.lit(",".join(f'"{v}"' for v in values)), F.lit("]"))
    body = F.concat(
        F.lit('{"content_type":"'), F.when(k % 13 == 11, "rumour").otherwise(F.col("content_type")), F.lit('","relevance":'), (k % 120).cast("string"), F.lit(',"information_gain":'), (k % 101).cast("string"), F.lit(',"entities":'),
        F.when(k % 17 == 3, quote([f"e{n}" for n in range(26)])).otherwise(quote("ab")), F.lit(',"topics":'), F.when(k % 19 == 5, quote(range(1, 12))).otherwise(quote("x")), F.when(k % 23 == 7, "").otherwise("}"),
    )
    kind = "content_type string, relevance double, information_gain double, entities array<string>, topics array<string>, _bad string"
    rows = items(spark, sf_dir).select("item_id", F.from_json(body, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    inside = lambda c: F.coalesce(c.between(0, 100), F.lit(False))
    outcome = F.when(F.col("x._bad").isNotNull() | F.col("x").isNull(), "json").when(~F.coalesce(F.col("x.content_type").isin(CONTENT_TYPES), F.lit(False)), "content_type")
    outcome = outcome.when(~(inside(F.col("x.relevance")) & inside(F.col("x.information_gain"))), "range").when(F.size("x.entities") > 25, "entities").when(F.size("x.topics") > 10, "topics").otherwise("valid")
    return rows.select("item_id", outcome.alias("outcome"))


_PICKED = [(tab, kind) for tab, kinds in TABS.items() for kind in kinds] + [("type:security", "security"), ("research", "research")]


@query(f"""WITH {SQL}, picked AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PICKED)}) t(category, content_type))
SELECT category, item_id FROM item JOIN picked USING (content_type)""")
def b10_category_filter(spark, sf_dir):
    """Items of every tab, of an exact type, and of a name that is no tab."""
    picked = spark.createDataFrame(_PICKED, "category string, content_type string")
    return items(spark, sf_dir).join(F.broadcast(picked), "content_type").select("category", "item_id")


_STORED = "CASE WHEN turn % 2 = 0 THEN '{\"answer\":\"' || text || '\",\"n\":1}' ELSE text || ' [E' || turn || '] [E12]' END"


@query(f"""SELECT conv_id, turn, trim(regexp_replace(CASE WHEN s LIKE '{{"answer":"%' THEN split_part(substr(s, 12), '","n":', 1) ELSE s END, ' ?\\[E[0-9]+\\]', '', 'g')) AS text FROM (SELECT conv_id, turn, {_STORED} AS s FROM conversations)""")
def b15_strip_stored_labels(spark, sf_dir):
    (talk,) = read_tables(spark, sf_dir, "conversations")
    stored = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"answer":"'), "text", F.lit('","n":1}'))).otherwise(F.concat("text", F.lit(" [E"), F.col("turn").cast("string"), F.lit("] [E12]")))
    inner = F.when(stored.startswith('{"answer":"'), F.split_part(F.substring(stored, 12, 2**30), F.lit('","n":'), F.lit(1))).otherwise(stored)
    return talk.select("conv_id", "turn", F.trim(F.regexp_replace(inner, r" ?\[E[0-9]+\]", "")).alias("text"))


@query(f"""WITH {SQL}, pair AS (SELECT a.source_id AS entity, b.source_id AS sibling, b.organization FROM source a JOIN source b USING (organization))
SELECT entity, sibling FROM pair p WHERE NOT EXISTS (SELECT 1 FROM source s WHERE s.organization = p.organization AND s.source_id <> p.sibling AND starts_with(p.sibling, s.source_id))""")
def c5_expand_siblings(spark, sf_dir):
    """Entities of the same organization, without those that a shorter sibling begins."""
    rows = sources(spark, sf_dir).select("source_id", "organization")
    other = rows.select(F.col("source_id").alias("sibling"), "organization")
    shorter = rows.select(F.col("source_id").alias("s"), F.col("organization").alias("o"))
    plain = other.join(shorter, (F.col("organization") == F.col("o")) & (F.col("s") != F.col("sibling")) & F.col("sibling").startswith(F.col("s")), "left_anti")
    return rows.join(plain, "organization").select(F.col("source_id").alias("entity"), "sibling")


@query(f"WITH {_SPARSE} SELECT b.item_id AS query_id, coalesce(max(contains(d.text, b.text)), false) AS found FROM benchmark b LEFT JOIN sparse s ON s.query_id = b.item_id LEFT JOIN documents d USING (doc_id) GROUP BY 1")
def c12_verify_original_evidence(spark, sf_dir):
    """Whether a question's whole assertion occurs in one of the documents retrieved for it."""
    docs, items_ = read_tables(spark, sf_dir, "documents", "benchmark")
    asked = items_.select(F.col("item_id").alias("query_id"), F.col("text").alias("assertion"))
    rows = sparse(spark, sf_dir).select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = asked.join(rows, "query_id", "left")
    return rows.groupBy("query_id").agg(F.coalesce(F.max(F.col("text").contains(F.col("assertion"))), F.lit(False)).alias("found"))


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'assistant' AND length(trim(text)) > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def c15_pending_support(spark, sf_dir):
    talk, labels = read_tables(spark, sf_dir, "conversations", "labels")
    claims = talk.filter((F.col("role") == "assistant") & (F.length(F.trim("text")) > 0)).select("conv_id", "turn")
    return claims.join(labels.select(F.col("doc_id").alias("conv_id")), "conv_id", "left_anti")


@query(f"""{_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)
SELECT count(*) FILTER (WHERE channels = 'sparse,temporal') AS both_channels, count(*) FILTER (WHERE channels = 'sparse') AS sparse_only, round(count(*) FILTER (WHERE channels = 'sparse') / count(*), 6) AS sparse_share,
median(rank) AS median_rank, max(rank) AS worst_rank, count(*) FILTER (WHERE rank > 10) AS beyond_ten FROM r JOIN (SELECT item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) USING (query_id, doc_id)""")
def d13_retrieval_summary(spark, sf_dir):
    """Which channels found the judged documents among the candidates, and at which fused rank."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = fused(spark, sf_dir).withColumn("rank", F.row_number().over(order).cast("long"))
    rows = rows.join(retrieval.holders(docs, benchmark_queries(spark, sf_dir)), ["query_id", "doc_id"])
    only = F.count_if(F.col("channels") == "sparse")
    return rows.agg(
        F.count_if(F.col("channels") == "sparse,temporal").alias("both_channels"), only.alias("sparse_only"), F.round(only / F.count("*"), 6).alias("sparse_share"),
        F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.max("rank").alias("worst_rank"), F.count_if(F.col("rank") > 10).alias("beyond_ten"),
    )


@query(f"WITH {_SPARSE}, {_MIX}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, channel) AS position FROM mix) SELECT query_id, doc_id, min(position) AS position FROM p GROUP BY ALL")
def d28_considered_documents(spark, sf_dir):
    position = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "channel")).cast("long")
    return channels(spark, sf_dir).withColumn("position", position).groupBy("query_id", "doc_id").agg(F.min("position").alias("position"))


@query(f"""{_FUSED.replace("WHERE rank <= 40", "WHERE rank <= 60")}, {_JUDGED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)
SELECT r.query_id, r.doc_id FROM r LEFT JOIN held h USING (query_id, doc_id) WHERE r.rank <= {TRACED} OR h.query_id IS NOT NULL""")
def e12_trace_keep(spark, sf_dir):
    """The first forty candidates by fused rank, and those that survived to the end (here: that hold the passage)."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    held = retrieval.holders(docs, benchmark_queries(spark, sf_dir)).withColumn("held", F.lit(True))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = fused(spark, sf_dir, 60).withColumn("rank", F.row_number().over(order)).join(held, ["query_id", "doc_id"], "left")
    return rows.filter((F.col("rank") <= TRACED) | F.col("held")).select("query_id", "doc_id")


@query(f"""WITH {_SPARSE}, {_SECOND}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC NULLS LAST, rank) AS reranked FROM second WHERE second IS NOT NULL AND rank <= {RERANKED})
SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY CASE WHEN f.reranked <= 10 THEN f.reranked END NULLS LAST, f.reranked NULLS LAST, s.rank) AS place FROM sparse s LEFT JOIN f USING (query_id, doc_id)""")
def e13_trace_funnel(spark, sf_dir):
    """Candidates by their final place (the first ten of the reranked ones), then the reranked, then the fused one."""
    rows = second_scores(spark, sf_dir)
    again = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("second"), "rank"))
    told = rows.filter(F.col("second").isNotNull() & (F.col("rank") <= RERANKED)).select("query_id", "doc_id", again.alias("reranked"))
    rows = rows.join(told, ["query_id", "doc_id"], "left")
    final = F.when(F.col("reranked") <= 10, F.col("reranked"))
    order = W.partitionBy("query_id").orderBy(final.asc_nulls_last(), F.asc_nulls_last("reranked"), "rank")
    return rows.select("query_id", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {_SPARSE}, u AS (SELECT query_id, doc_id, 0 AS part, rank FROM sparse WHERE doc_id % 5 = 0 UNION ALL SELECT query_id, doc_id, 1, rank FROM sparse),
f AS (SELECT query_id, doc_id, min((part, rank)) AS first FROM u GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place FROM f""")
def f3_merge_distractors(spark, sf_dir):
    """Distractors first, then the hits; a document's first place counts."""
    hits = sparse(spark, sf_dir).select("query_id", "doc_id", "rank")
    both = hits.filter("doc_id % 5 = 0").withColumn("part", F.lit(0)).unionByName(hits.withColumn("part", F.lit(1)))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("part", "rank")).alias("first"))
    return first.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("first")).cast("long").alias("place"))


@query("SELECT doc_id, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_active FROM documents")
def f6_activate_chunk_set(spark, sf_dir):
    """The newest set of each revision is active; older ones stay, inactive. By a sum per key, as a window would hold a key's rows together."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    newest = docs.groupBy("source").agg(F.max("doc_id").alias("newest"))
    return docs.select("doc_id", "source").join(newest, "source").select("doc_id", (F.col("doc_id") == F.col("newest")).alias("is_active"))


_BAG = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH t AS (SELECT b.item_id AS query_id, c.conv_id, c.turn, {_BAG.format("b.text")} AS x, {_BAG.format("c.text")} AS y FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)),
m AS (SELECT *, len(list_intersect(x, y)) AS shared, least(len(x), len(y)) AS small FROM t), j AS (SELECT *, round(shared / nullif(len(x) + len(y) - shared, 0), 6) AS jaccard FROM m)
SELECT conv_id, turn, coalesce(jaccard, 0e0) AS jaccard, coalesce(CASE WHEN small < 3 THEN jaccard ELSE round(shared / small, 6) END, 0e0) AS containment FROM j""")
def g8_set_similarity(spark, sf_dir):
    talk, items_ = read_tables(spark, sf_dir, "conversations", "benchmark")
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    x, y = bag("passage"), bag("text")
    size = items_.agg(F.count("*").alias("size"))  # one row
    rows = talk.crossJoin(F.broadcast(size)).withColumn("item_id", F.col("conv_id") % F.col("size")).join(items_.withColumnRenamed("text", "passage"), "item_id").select("conv_id", "turn", x.alias("x"), y.alias("y"))
    shared, small = F.size(F.array_intersect("x", "y")), F.least(F.size("x"), F.size("y"))
    union = F.size("x") + F.size("y") - shared
    jaccard = F.when(union > 0, F.round(shared / union, 6)).otherwise(0.0)
    return rows.select("conv_id", "turn", jaccard.alias("jaccard"), F.when(small < 3, jaccard).otherwise(F.round(shared / F.when(small > 0, small), 6)).alias("containment"))


@query(f"""WITH {SQL}, q AS (SELECT item_id AS query_id, TIMESTAMP '2024-01-01' + to_hours(CAST(item_id % 20 AS INTEGER)) AS begin_at, TIMESTAMP '2024-01-02' + to_hours(CAST(item_id % 20 AS INTEGER)) AS end_at, CASE item_id % 3 WHEN 0 THEN regexp_extract_all(text, '[A-Z][a-z]+') END AS entities, item_id % 2 = 0 AS official FROM benchmark),
i AS (SELECT item_id, coalesce(published_at, observed_at) AS moment, regexp_extract(title, '^([A-Z][a-z]+)', 1) AS subject, tier FROM item JOIN source USING (source_id))
SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY moment DESC, item_id DESC) AS rank, 0e0 AS score FROM q JOIN i ON moment >= begin_at AND moment < end_at AND (NOT official OR tier = 'primary') AND (entities IS NULL OR (subject <> '' AND list_contains(entities, subject))) QUALIFY rank <= 40""")
def h4_temporal_topk(spark, sf_dir):
    """The newest forty items in each question's window, for some only of leading sources or with a subject that the
    question names. Windows meet items by the days they touch; what meets is verified."""
    (bench,) = read_tables(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    begin, end = (F.lit(d).cast("timestamp") + F.make_interval(hours=(k % 20).cast("int")) for d in ("2024-01-01", "2024-01-02"))
    asked = bench.select(k.alias("query_id"), begin.alias("begin_at"), end.alias("end_at"), F.when(k % 3 == 0, F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("entities"), (k % 2 == 0).alias("official"))
    asked = asked.withColumn("day", F.explode(F.sequence(F.to_date("begin_at"), F.to_date("end_at"))))
    rows = items(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_id", "tier")), "source_id")
    rows = rows.select("item_id", F.coalesce("published_at", "observed_at").cast("timestamp").alias("at"), F.regexp_extract("title", "^([A-Z][a-z]+)", 1).alias("subject"), "tier").withColumn("day", F.to_date("at"))
    fits = (F.col("at") >= F.col("begin_at")) & (F.col("at") < F.col("end_at")) & (~F.col("official") | (F.col("tier") == "primary"))
    fits = fits & (F.col("entities").isNull() | ((F.col("subject") != "") & F.array_contains("entities", F.col("subject"))))
    newest = W.partitionBy("query_id").orderBy(F.desc("at"), F.desc("item_id"))
    return asked.join(rows, "day").filter(fits).select("query_id", "item_id", F.row_number().over(newest).cast("long").alias("rank"), F.lit(0.0).alias("score")).filter("rank <= 40")


@query(f"""WITH {_SPARSE}, {_SECOND} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= {RERANKED} AND second IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN rank <= {RERANKED} THEN second END DESC NULLS LAST, rank) AS place FROM second""")
def h8_rerank_with_scores(spark, sf_dir):
    """The head in the order of a second score, what has none and the tail behind it in the order it had."""
    head = (F.col("rank") <= RERANKED) & F.col("second").isNotNull()
    order = W.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.col("second")).desc_nulls_last(), "rank")
    return second_scores(spark, sf_dir).select("query_id", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query(f"""{_RANKED}, e AS (SELECT r.*, epoch(ts) AS moment, epoch(TIMESTAMP '2024-01-01') AS a, epoch(TIMESTAMP '2024-01-01') + 86400 * (r.query_id % 4) AS z, r.query_id % 3 > 0 AS fresh FROM ranked r LEFT JOIN events ON event_id = doc_id AND doc_id % 6 <> 0),
m AS (SELECT *, min(score) OVER q AS lo, max(score) OVER q AS hi FROM e WINDOW q AS (PARTITION BY query_id)), f AS (SELECT query_id, doc_id, rank, fresh, round(0.7e0 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1e0 END + 0.3e0 * coalesce(CASE WHEN z > a AND moment IS NOT NULL THEN least(1, greatest(0, (moment - a) / (z - a))) END, 0.5e0), 5) AS fit FROM m)
SELECT query_id, doc_id, CASE WHEN fresh THEN fit END AS fit, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fresh THEN -fit ELSE rank END, doc_id) AS place FROM f""")
def h10_temporal_fit(spark, sf_dir):
    """Relevance and the place in the question's window (none of no length), where freshness matters; else the order stays.
    A candidate without a date is in the window's middle, one outside at its end."""
    (events,) = read_tables(spark, sf_dir, "events")
    dates = events.filter("event_id % 6 <> 0").select(F.col("event_id").alias("doc_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    own = W.partitionBy("query_id")
    rows = sparse(spark, sf_dir).join(dates, "doc_id", "left")
    begin = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) / 1e6
    rows = rows.withColumns({"lo": F.min("score").over(own), "hi": F.max("score").over(own), "a": begin, "z": begin + 86_400 * (F.col("query_id") % 4), "fresh": F.col("query_id") % 3 > 0})
    relevance = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - F.col("a")) / (F.col("z") - F.col("a"))))
    place = F.coalesce(F.when((F.col("z") > F.col("a")) & F.col("at").isNotNull(), inside), F.lit(0.5))
    rows = rows.withColumn("fit", F.when(F.col("fresh"), F.round(0.7 * relevance + 0.3 * place, 5)))
    order = own.orderBy(F.when(F.col("fresh"), -F.col("fit")).otherwise(F.col("rank")), "doc_id")
    return rows.select("query_id", "doc_id", "fit", F.row_number().over(order).cast("long").alias("place"))


_FOLD = f"""{_RANKED}, o AS (SELECT *, doc_id % 37 = 5 AS lost, CASE WHEN doc_id % 8 = 1 THEN 'alone-' || doc_id ELSE 's' || story_id END AS story FROM ranked), a AS (SELECT *, CASE WHEN NOT lost THEN row_number() OVER (PARTITION BY query_id, story, source_id, lost ORDER BY rank) END AS of_source FROM o),
b AS (SELECT *, sum(CASE WHEN of_source = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, story ORDER BY rank ROWS UNBOUNDED PRECEDING) AS of_story FROM a),
c AS (SELECT *, coalesce(of_source = 1 AND of_story <= {PER_STORY}, false) AS kept FROM b), d AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS n FROM c)"""


@query(f"{_FOLD} SELECT query_id, doc_id, CASE WHEN lost THEN 'no_facts' WHEN n - CASE WHEN kept THEN 1 ELSE 0 END >= {KEPT} THEN 'budget' WHEN NOT kept THEN 'story_fold' ELSE 'kept' END AS outcome FROM d")
def h12_fold_by_story(spark, sf_dir):
    """One passage per source of a story, three per story, in order, up to ten; with what became of each. Documents
    without a story (here: every eighth) stay; those without facts (some) don't count."""
    rows, doc = ranked(spark, sf_dir), F.col("doc_id")
    rows = rows.withColumns({"lost": doc % 37 == 5, "story": F.when(doc % 8 == 1, F.concat(F.lit("alone-"), doc.cast("string"))).otherwise(F.concat(F.lit("s"), F.col("story_id").cast("string")))})
    rows = rows.withColumn("of_source", F.when(~F.col("lost"), F.row_number().over(W.partitionBy("query_id", "story", "source_id", "lost").orderBy("rank"))))
    story = W.partitionBy("query_id", "story").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("of_story", F.sum(F.when(F.col("of_source") == 1, 1).otherwise(0)).over(story))
    rows = rows.withColumn("kept", F.coalesce((F.col("of_source") == 1) & (F.col("of_story") <= PER_STORY), F.lit(False)))
    n = F.sum(F.col("kept").cast("int")).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)) - F.col("kept").cast("int")
    return rows.select("query_id", "doc_id", F.when(F.col("lost"), "no_facts").when(n >= KEPT, "budget").when(~F.col("kept"), "story_fold").otherwise("kept").alias("outcome"))


@query(f"""{_RANKED}, f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, story_id) AS first FROM ranked)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, tier_order, rank) AS place FROM f""")
def h13_main_source_first(spark, sf_dir):
    first = F.min("rank").over(W.partitionBy("query_id", "story_id"))
    order = W.partitionBy("query_id").orderBy("first", "tier_order", "rank")
    return ranked(spark, sf_dir).withColumn("first", first).select("query_id", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {_SPARSE}, {_JUDGED}, t AS (SELECT query_id, score, query_id IN (SELECT query_id FROM held) AS answerable FROM sparse WHERE rank = 1), r AS (SELECT *, row_number() OVER (PARTITION BY answerable ORDER BY score, query_id) AS r, count(*) OVER (PARTITION BY answerable) AS n FROM t)
SELECT answerable, max(n) AS n, round(avg(score), 5) AS mean, min(score) AS least, max(score) AS most, max(score) FILTER (WHERE r = greatest(1, CAST(round_even(0.1 * n, 0) AS BIGINT))) AS p10, max(score) FILTER (WHERE r = greatest(1, CAST(round_even(0.9 * n, 0) AS BIGINT))) AS p90,
  count(*) FILTER (WHERE CASE WHEN answerable THEN score <= (SELECT max(score) FROM t WHERE NOT answerable) ELSE score >= (SELECT min(score) FROM t WHERE answerable) END) AS overlap FROM r GROUP BY answerable""")
def j6_abstention_separation(spark, sf_dir):
    """The best scores of questions with an answer in the corpus, and of those without; how many lie within the other's range."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    hit = retrieval.holders(docs, benchmark_queries(spark, sf_dir)).select("query_id").distinct().withColumn("hit", F.lit(True))
    top = sparse(spark, sf_dir).filter("rank = 1").join(hit, "query_id", "left").select("query_id", "score", F.coalesce("hit", F.lit(False)).alias("answerable"))
    own = W.partitionBy("answerable")
    limits = top.agg(F.max(F.when(~F.col("answerable"), F.col("score"))).alias("high"), F.min(F.when(F.col("answerable"), F.col("score"))).alias("low"))
    rows = top.withColumns({"r": F.row_number().over(own.orderBy("score", "query_id")), "n": F.count("*").over(own)}).crossJoin(F.broadcast(limits))  # a row a question
    at = lambda share: F.max(F.when(F.col("r") == F.greatest(F.lit(1), F.bround(F.lit(share) * F.col("n"), 0).cast("long")), F.col("score")))
    inside = F.when(F.col("answerable"), F.col("score") <= F.col("high")).otherwise(F.col("score") >= F.col("low"))
    return rows.groupBy("answerable").agg(
        F.max("n").alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), at(0.1).alias("p10"), at(0.9).alias("p90"), F.count_if(inside).alias("overlap")
    )
