"""The whole way from questions to evidence: plans, three channels in the question's window, fusion, boosts, ranks, selection."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import questions as Q
from corpusloom.operators import channels, retrieval
from corpusloom.operators.graph import Rounds
from corpusloom.plans.answers import _PLAN
from corpusloom.plans.evaluation import _WORDS
from corpusloom.plans.funnel import second_scores
from corpusloom.plans.ranking import FRESH, boosted, facts, select_evidence, with_dimensions
from corpusloom.plans.registry import query
from corpusloom.sources.tables import PHRASES, QUESTION_SQL, ZONE, read_tables

#: when the first question is asked; the others at hours after it, by number
ASKED = "2024-01-03 00:00:00"
_SUBJECT = "regexp_extract(split_part(text, '.', 1), '^([A-Z][a-z]+)', 1)"
_ASKED = f"""{QUESTION_SQL[: QUESTION_SQL.index("question AS (")]}question AS (SELECT item_id AS query_id, text, phrase || ' ' || text AS question, TIMESTAMP '{ASKED}' + to_hours(CAST(item_id % 48 AS INTEGER)) AS asked_at FROM benchmark JOIN phrase ON phrase_no = item_id % {len(PHRASES)}){_PLAN[len(QUESTION_SQL):]},
w AS (SELECT query_id, text, timezone('UTC', timezone('{ZONE}', begin_at)) AS b, timezone('UTC', timezone('{ZONE}', end_at)) AS e, list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')) AS entities FROM planned)"""
_SPARSE = f"""posting AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM posting GROUP BY term), total AS (SELECT count(*) AS n FROM documents), qt AS (SELECT query_id, b, e, entities, unnest({_WORDS}) AS term FROM w),
wt AS (SELECT query_id, b, e, term, ln(n / df) * CASE WHEN list_contains(list_transform(entities, lambda x: lower(x)), term) THEN 3e0 ELSE 1e0 END AS weight FROM qt JOIN df USING (term), total WHERE df <= greatest(1, floor(n * 0.15))),
ss AS (SELECT query_id, doc_id, round(sum(weight), 6) AS score FROM wt JOIN posting USING (term) LEFT JOIN events ON event_id = doc_id WHERE b IS NULL OR (ts >= b AND ts < e) GROUP BY query_id, doc_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss QUALIFY rank <= 40)"""
_DENSE = """ds AS (SELECT query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM w JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON true JOIN documents d ON d.doc_id = v.vec_id LEFT JOIN events ON event_id = v.vec_id WHERE b IS NULL OR (ts >= b AND ts < e)),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 60)"""
_TEMPORAL = f"""dated AS (SELECT doc_id, ts, {_SUBJECT} AS subject FROM documents JOIN events ON event_id = doc_id),
temporal AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, doc_id DESC) AS rank FROM w JOIN dated ON ts >= b AND ts < e QUALIFY rank <= 40),
entity_temporal AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, doc_id DESC) AS rank FROM w JOIN dated ON ts >= b AND ts < e WHERE subject <> '' AND list_contains(entities, subject) QUALIFY rank <= 40)"""
_WAYS = f"WITH {_ASKED}, {_SPARSE}, {_DENSE}, {_TEMPORAL}"
_MIX = " UNION ALL ".join(f"SELECT query_id, doc_id, rank, '{c}' AS channel, {w} AS weight FROM {c}" for c, w in retrieval.WEIGHTS.items())


def asked(spark, sf_dir):
    """The benchmark's texts as questions with a phrasing, planned: type, kind and window (in UTC), and the names in them."""
    (bench,) = read_tables(spark, sf_dir, "benchmark")
    phrases = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PHRASES)], "phrase_no int, phrase string")
    rows = bench.withColumn("phrase_no", (F.col("item_id") % len(PHRASES)).cast("int")).join(F.broadcast(phrases), "phrase_no")
    at = F.lit(ASKED).cast("timestamp") + F.make_interval(hours=(F.col("item_id") % 48).cast("int"))
    rows = rows.select(F.col("item_id").alias("query_id"), "text", F.concat_ws(" ", "phrase", "text").alias("question"), at.alias("asked_at"))
    rows = rows.withColumns({"question_type": Q.question_type(F.col("question")), "kind": Q.window_kind(F.col("question"))})
    begin, end = (F.to_utc_timestamp(b, ZONE) for b in Q.window_bounds(F.col("question"), F.col("kind"), F.col("asked_at")))
    return rows.withColumns({"begin_at": begin, "end_at": end, "entities": F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))})


def dated(spark, sf_dir):
    docs, events = read_tables(spark, sf_dir, "documents", "events")
    times = events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("at"))
    subject = F.regexp_extract(F.split_part("text", F.lit("."), F.lit(1)), "^([A-Z][a-z]+)", 1)
    return docs.join(times, "doc_id", "left").select("doc_id", "at", "text", subject.alias("subject"))


def dense(spark, sf_dir, questions):
    """query_id, doc_id, rank; a question's vector is that with its number."""
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    known = dated(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "at").join(vectors, "vec_id")
    own = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).join(questions, "query_id")
    return retrieval.dense_topk(own, known, windows=True).withColumnRenamed("vec_id", "doc_id")


def ways(spark, sf_dir, questions):
    """query_id, channel, doc_id, rank of all channels, each found by itself."""
    docs = dated(spark, sf_dir)
    index = channels.write_index(docs, Rounds(spark, "index"))
    found = {
        "dense": dense(spark, sf_dir, questions),
        "sparse": channels.sparse_topk(questions, index),
        "temporal": channels.temporal_topk(questions, docs),
        "entity_temporal": channels.temporal_topk(questions, docs, of_entities=True),
    }
    rows = [f.select("query_id", F.lit(name).alias("channel"), F.col("doc_id").cast("long").alias("doc_id"), "rank") for name, f in found.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


@query(f"{_WAYS} SELECT query_id, doc_id, score, rank FROM sparse")
def h3_sparse_window(spark, sf_dir):
    """The best forty documents by words in each question's window, names thrice."""
    index = channels.write_index(dated(spark, sf_dir), Rounds(spark, "index"))
    return channels.sparse_topk(asked(spark, sf_dir), index).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_WAYS} SELECT query_id, doc_id, score, rank FROM dense")
def h1_dense_window(spark, sf_dir):
    """The sixty nearest documents in each question's window."""
    return dense(spark, sf_dir, asked(spark, sf_dir)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"{_WAYS} SELECT query_id, 'temporal' AS channel, doc_id, rank FROM temporal UNION ALL SELECT query_id, 'entity_temporal', doc_id, rank FROM entity_temporal")
def h4_temporal_window(spark, sf_dir):
    """The newest forty documents in each question's window, and those whose subject it names."""
    docs, questions = dated(spark, sf_dir), asked(spark, sf_dir)
    rows = [channels.temporal_topk(questions, docs, of_entities=e).select("query_id", F.lit(n).alias("channel"), "doc_id", F.col("rank").cast("long").alias("rank")) for n, e in (("temporal", False), ("entity_temporal", True))]
    return rows[0].union(rows[1])


@query(f"""{_WAYS}, mix AS ({_MIX}), f AS (SELECT query_id, doc_id, round(sum(CAST(weight AS DOUBLE) / (60 + rank)), 9) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM mix GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f""")
def h5_rrf_channels(spark, sf_dir):
    """Reciprocal ranks of the four independent channels."""
    return retrieval.reciprocal_ranks(ways(spark, sf_dir, asked(spark, sf_dir))).withColumn("rank", F.col("rank").cast("long"))


def depth_of(kind):
    return F.when(kind.isin("comparison", "recent_updates"), 20).otherwise(40)


@query()
def h15_retrieve_batch(spark, sf_dir):
    """All questions through their plan, the channels in its window, fusion, boosts, the depth of their type, a second score,
    dimensions and freshness, and selection; each candidate with its ranks on the way and what became of it."""
    rounds = Rounds(spark, "retrieve")
    questions = rounds.save(asked(spark, sf_dir), "questions")
    fused = rounds.save(retrieval.reciprocal_ranks(ways(spark, sf_dir, questions)).filter("rank <= 60").select("query_id", "doc_id", "score", "channels"), "fused")
    return traced(fused, facts(spark, sf_dir), questions, second_scores(spark, sf_dir).select("query_id", "doc_id", "second"))


def traced(fused, known, questions, second):
    """query_id, doc_id, channels, ranks and outcome of the fused candidates."""
    place = lambda by: F.row_number().over(W.partitionBy("query_id").orderBy(*by, "doc_id"))
    kind, plan = F.col("question_type"), questions.select("query_id", "question", "question_type", "begin_at", "end_at", "entities")
    rows = boosted(fused, known, plan, (F.col("begin_at"), F.col("end_at")), kind)
    rows = rows.withColumns({"fused_rank": place([F.desc("score")]), "boosted_rank": place([F.desc("boosted")])})
    head = rows.filter(F.col("boosted_rank") <= depth_of(kind)).join(second, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("second", F.lit(0.0)) + F.col("boosted"))
    head = with_dimensions(head, kind)
    adjusted = F.col("relevance") + 0.1 * F.col("directness") + 0.08 * F.col("fit")
    moment, begin, end = (F.unix_micros(c) for c in ("at", "begin_at", "end_at"))
    recency = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (moment - begin) / (end - begin))), F.lit(0.5))
    final = F.when(kind.isin(FRESH), 0.7 * adjusted + 0.3 * recency).otherwise(adjusted)
    ranked = head.withColumn("final", F.round(final, 6)).withColumn("rank", place([F.desc("final")]))
    chosen = select_evidence(ranked.withColumns({"item_id": F.concat_ws("-", "source", F.floor(F.col("doc_id") / 60).cast("string")), "story": F.floor(F.col("doc_id") / 10), "exempt": F.lit(False)}))
    trace = rows.select("query_id", "doc_id", "channels", "fused_rank", "boosted_rank").join(ranked.select("query_id", "doc_id", F.col("rank").alias("final_rank")), ["query_id", "doc_id"], "left").join(chosen, ["query_id", "doc_id"], "left")
    return trace.withColumn("outcome", F.coalesce("outcome", F.when(F.col("final_rank").isNull(), "beyond_depth").otherwise("not_reached")))
