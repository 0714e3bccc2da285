"""From fused candidates to the evidence shown: boosts, dimensions, caps, folding; sweeps of weights and types."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans.evaluation import _FUSED, _JUDGED, _SPARSE, benchmark_queries, fused, judgments, sparse
from corpusloom.plans.funnel import channels
from corpusloom.plans.reads import with_canonical
from corpusloom.plans.registry import query
from corpusloom.sources.tables import CONTENT_TYPES, TIERS, read_tables

# How well a tier of sources answers a type of question.
AFFINITY = {
    "recent_updates": {"primary": 1.0, "secondary": 0.3, "expert": 0.2, "community": 0.0},
    "fact_check": {"primary": 1.0, "secondary": 0.4, "expert": 0.4, "community": -0.2},
    "timeline": {"primary": 1.0, "secondary": 0.4, "expert": 0.2, "community": 0.0},
    "explainer": {"primary": -0.3, "secondary": 0.5, "expert": 1.0, "community": 0.2},
    "comparison": {"primary": 0.5, "secondary": 0.6, "expert": 0.8, "community": 0.0},
}
TYPES = list(AFFINITY)
FRESH = ["recent_updates", "timeline"]
#: the window of every question here, and a second one of two days
WINDOW = ("2024-01-01 00:00:00", "2024-01-02 12:00:00")

_TIER = "CASE CAST(substr(source, 4, 10) AS INTEGER) % 4 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TIERS)) + " END"
_KIND = "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(CONTENT_TYPES)) + " END"
_TYPE = "CASE query_id % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TYPES)) + " END"
_FACTS = f"""fact AS (SELECT doc_id, source, {_TIER} AS tier, {_KIND} AS content_type, split_part(text, '.', 1) AS title, regexp_extract(text, '^([A-Z][a-z]+)', 1) AS subject, e.ts AS moment, min(doc_id) OVER (PARTITION BY text) < doc_id AS is_copy FROM documents LEFT JOIN events e ON e.event_id = doc_id),
asked AS (SELECT item_id AS query_id, text AS question, regexp_extract_all(text, '[A-Z][a-z]+') AS entities FROM benchmark)"""


def facts(spark, sf_dir):
    """What ranking needs of each document: source, tier, type, title, subject, time, whether it is a copy."""
    docs, events = read_tables(spark, sf_dir, "documents", "events")
    rows = with_canonical(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("body"), "source"))
    times = events.select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("at"))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    doc = F.col("item_id")
    return rows.select(
        doc.alias("doc_id"), "source", pick(TIERS, F.substring("source", 4, 10).cast("int") % 4).alias("tier"), pick(CONTENT_TYPES, doc % 10).alias("content_type"),
        F.split_part("body", F.lit("."), F.lit(1)).alias("title"), F.regexp_extract("body", "^([A-Z][a-z]+)", 1).alias("subject"), (F.col("canonical_id") < doc).alias("is_copy"),
    ).join(times, "doc_id", "left")


def question_type():
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("query_id") % 5 + 1).cast("int"))


def boosted(rows, known, asked, window=WINDOW, kind=None):
    """``rows`` (query_id, doc_id, score) with the score on [0, 1] and what each candidate's facts add to it, each once."""
    kind = question_type() if kind is None else kind
    begin, end = (F.lit(b).cast("timestamp") if isinstance(b, str) else b for b in window)
    own = W.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    base = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    both = rows.withColumn("base", base).join(known, "doc_id").join(asked, "query_id")
    add = lambda hit, worth: F.when(F.coalesce(hit, F.lit(False)), worth).otherwise(0.0)
    inside = (F.col("at") >= begin) & (F.col("at") < end)
    subject = (F.col("subject") != "") & F.array_contains("entities", F.col("subject"))
    opinion = (F.col("content_type") == "opinion") & (kind == "fact_check")
    extra = add(F.col("tier") == "primary", 0.08) + add(inside, 0.05) + add(subject, 0.05) + add(F.col("is_copy"), -0.10) + add(opinion, -0.15)
    return both.withColumn("boosted", F.round(F.col("base") + extra, 6))


def asked(spark, sf_dir):
    return benchmark_queries(spark, sf_dir).select("query_id", F.col("text").alias("question"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("entities"))


_BOOSTED = f"""{_FACTS}, base AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1e0 END AS base FROM fused WINDOW q AS (PARTITION BY query_id)),
boosted AS (SELECT query_id, doc_id, fact.*, question, round(base + CASE WHEN tier = 'primary' THEN 0.08e0 ELSE 0 END + CASE WHEN moment >= TIMESTAMP '{WINDOW[0]}' AND moment < TIMESTAMP '{WINDOW[1]}' THEN 0.05e0 ELSE 0 END + CASE WHEN subject <> '' AND list_contains(entities, subject) THEN 0.05e0 ELSE 0 END
  - CASE WHEN is_copy THEN 0.1e0 ELSE 0 END - CASE WHEN content_type = 'opinion' AND {_TYPE} = 'fact_check' THEN 0.15e0 ELSE 0 END, 6) AS boosted FROM base JOIN fact USING (doc_id) JOIN asked USING (query_id))"""


@query(f"{_FUSED}, {_BOOSTED} SELECT query_id, doc_id, boosted AS score FROM boosted")
def h6_boosts(spark, sf_dir):
    rows = boosted(fused(spark, sf_dir).select("query_id", "doc_id", "score"), facts(spark, sf_dir), asked(spark, sf_dir))
    return rows.select("query_id", "doc_id", F.col("boosted").alias("score"))


# ---- dimensions

_TERM, _NAME = "[一-鿿぀-ヿ]|[a-z0-9][a-z0-9.+-]*", "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '" + _TERM + "'), lambda t: length(t) >= 2 OR regexp_matches(t, '[一-鿿぀-ヿ]')))"
_NAMES = "list_distinct(list_filter(regexp_extract_all(lower({}), '" + _NAME + "'), lambda t: length(t) >= 3 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]')))"
_NAMED = "question || ' mdl' || (query_id % 3) || '.5 四'", "title || ' mdl' || (doc_id % 3) || '.5 四'"


def terms(text):
    """CJK characters and Latin words of two and more characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda t: (F.length(t) >= 2) | F.regexp_like(t, F.lit("[一-鿿぀-ヿ]"))))


def identifiers(text):
    """Names of three and more characters with letters and digits."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(_NAME), F.lit(0)), lambda t: (F.length(t) >= 3) & F.regexp_like(t, F.lit("[a-z]")) & F.regexp_like(t, F.lit("[0-9]"))))


def share(a, b):
    """The part of a set that another has; 0 for an empty one."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def affinity(kind, tier):
    table = F.create_map(*[F.lit(v) for k, row in AFFINITY.items() for t, worth in row.items() for v in (f"{k}/{t}", worth)])
    return F.coalesce(table[F.concat_ws("/", kind, tier)], F.lit(0.0))


_AFFINITY = "CASE {} || '/' || tier " + " ".join(f"WHEN '{k}/{t}' THEN {v}" for k, row in AFFINITY.items() for t, v in row.items()) + " ELSE 0 END"


def named(spark, sf_dir):
    """Candidates with question and title, both with a model's name and a CJK character behind, as the texts have none."""
    rows = sparse(spark, sf_dir).select("query_id", "doc_id", "score", "rank").join(facts(spark, sf_dir), "doc_id").join(asked(spark, sf_dir), "query_id")
    tail = lambda c, k: F.concat(c, F.lit(" mdl"), (F.col(k) % 3).cast("string"), F.lit(".5 四"))
    return rows.withColumns({"question": tail("question", "query_id"), "title": tail("title", "doc_id")})


_DIMENSIONS = f"""{_FACTS}, cand AS (SELECT s.query_id, s.doc_id, s.score, s.rank, tier, moment, {_NAMED[0]} AS question, {_NAMED[1]} AS title FROM sparse s JOIN fact USING (doc_id) JOIN asked USING (query_id)),
dim AS (SELECT *, CASE WHEN len({_TERMS.format("question")}) > 0 THEN len(list_intersect({_TERMS.format("question")}, {_TERMS.format("title")})) / len({_TERMS.format("question")}) ELSE 0 END AS directness, {_AFFINITY.format(_TYPE)} AS fit,
  CASE WHEN len({_NAMES.format("question")}) > 0 THEN len(list_intersect({_NAMES.format("question")}, {_NAMES.format("title")})) / len({_NAMES.format("question")}) ELSE 0 END AS names,
  CASE WHEN max(score) OVER q > min(score) OVER q THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1e0 END AS relevance FROM cand WINDOW q AS (PARTITION BY query_id))"""


def with_dimensions(rows, kind):
    own = W.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    rows = rows.withColumn("relevance", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    return rows.withColumns({"directness": share(terms(F.col("question")), terms(F.col("title"))), "fit": affinity(kind, F.col("tier")), "names": share(identifiers(F.col("question")), identifiers(F.col("title")))})


@query(f"WITH {_SPARSE}, {_DIMENSIONS} SELECT query_id, doc_id, round(directness, 6) AS directness, round(CAST(fit AS DOUBLE), 6) AS source_fit, round(names, 6) AS identifier_fit FROM dim")
def g12_directness(spark, sf_dir):
    """The share of a question's terms in a candidate's title, its tier's affinity to the type of question, and the share of names kept."""
    rows = with_dimensions(named(spark, sf_dir), question_type())
    return rows.select("query_id", "doc_id", F.round("directness", 6).alias("directness"), F.round("fit", 6).alias("source_fit"), F.round("names", 6).alias("identifier_fit"))


@query(f"WITH {_SPARSE}, {_DIMENSIONS}, a AS (SELECT query_id, doc_id, round(relevance + 0.1e0 * directness + 0.08e0 * fit + 0.12e0 * names, 6) AS adjusted FROM dim) SELECT query_id, doc_id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, doc_id) AS place FROM a")
def h9_dimension_rerank(spark, sf_dir):
    rows = with_dimensions(named(spark, sf_dir), question_type())
    rows = rows.select("query_id", "doc_id", F.round(F.col("relevance") + 0.1 * F.col("directness") + 0.08 * F.col("fit") + 0.12 * F.col("names"), 6).alias("adjusted"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("adjusted"), "doc_id")).cast("long"))


# ---- evidence

POOL, PER_ITEM, PER_SOURCE, CAPPED, PER_STORY, SHOWN = 60, 2, 3, 30, 3, 10


def select_evidence(rows):
    """query_id, doc_id, outcome of ranked candidates (query_id, doc_id, rank, item_id, source, story, exempt).

    Of the first sixty at most two of a document and three of a source (exempt ones of any number) go on, thirty at
    most; of those at most three of a story, one a source, ten in all. Documents of an item have one source.
    """

    rows = rows.filter(F.col("rank") <= POOL).select("query_id", "doc_id", "rank", "item_id", "source", "story", "exempt")
    upto = lambda *keys: W.partitionBy("query_id", *keys).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    number = lambda hit, *keys: F.sum(hit.cast("int")).over(upto(*keys))
    # a source is full at the rank of its third row; from there on only exempt rows of it count
    counts = (F.row_number().over(upto("item_id").rowsBetween(W.unboundedPreceding, 0)) <= PER_ITEM) & ~F.col("exempt")
    rows = rows.withColumn("counts", counts)
    rows = rows.withColumn("full", F.when(F.col("counts") & (number(F.col("counts"), "source") == PER_SOURCE), F.col("rank")))
    rows = rows.withColumn("full", F.min("full").over(W.partitionBy("query_id", "source")))
    rows = rows.withColumn("inside", F.col("exempt") | F.col("full").isNull() | (F.col("rank") <= F.col("full")))
    rows = rows.withColumn("open", F.col("inside") & (number(F.col("inside"), "item_id") <= PER_ITEM))
    rows = rows.withColumns({"n": number(F.col("open")), "of_item": number(F.col("open"), "item_id")})
    rows = rows.filter((F.col("n") < CAPPED) | ((F.col("n") == CAPPED) & F.col("open")))
    rows = rows.withColumn("new", F.col("open") & (number(F.col("open"), "story", "source") == 1))
    rows = rows.withColumn("fits", F.col("new") & (number(F.col("new"), "story") <= PER_STORY))
    shown = number(F.col("fits")) - F.col("fits").cast("int")
    capped = F.when(F.col("of_item") >= PER_ITEM, "document_cap").otherwise("source_cap")
    outcome = F.when(~F.col("open"), capped).when(shown >= SHOWN, "budget").when(F.col("fits"), "evidence").otherwise("story_fold")
    return rows.select("query_id", "doc_id", outcome.alias("outcome"))


_WIDE = _FUSED.replace("WHERE rank <= 40", "WHERE rank <= 60")


@query(f"""{_WIDE}, p AS (SELECT query_id, doc_id, source, source || '-' || (doc_id // 60) AS item_id, doc_id // 10 AS story, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused JOIN documents USING (doc_id) QUALIFY rank <= {POOL}),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY rank) AS of_item FROM p), o AS (SELECT *, CASE WHEN of_item <= {PER_ITEM} THEN row_number() OVER (PARTITION BY query_id, source, of_item <= {PER_ITEM} ORDER BY rank) END AS of_source FROM i),
c AS (SELECT *, coalesce(of_source <= {PER_SOURCE}, false) AS open, sum(CASE WHEN of_source <= {PER_SOURCE} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS n FROM o),
a AS (SELECT *, CASE WHEN open THEN row_number() OVER (PARTITION BY query_id, story, source, open ORDER BY rank) END AS again FROM c WHERE n < {CAPPED} OR (n = {CAPPED} AND open)),
b AS (SELECT *, sum(CASE WHEN again = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, story ORDER BY rank ROWS UNBOUNDED PRECEDING) AS of_story FROM a),
f AS (SELECT *, sum(CASE WHEN again = 1 AND of_story <= {PER_STORY} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS kept FROM b)
SELECT query_id, doc_id, CASE WHEN of_item > {PER_ITEM} AND NOT coalesce((SELECT count(*) FROM o x WHERE x.query_id = f.query_id AND x.item_id = f.item_id AND x.of_source <= {PER_SOURCE} AND x.rank < f.rank), 0) < {PER_ITEM} THEN 'document_cap'
  WHEN NOT open THEN 'source_cap' WHEN kept - CASE WHEN again = 1 AND of_story <= {PER_STORY} THEN 1 ELSE 0 END >= {SHOWN} THEN 'budget' WHEN again = 1 AND of_story <= {PER_STORY} THEN 'evidence' ELSE 'story_fold' END AS outcome FROM f""")
def h11_select_evidence(spark, sf_dir):
    """The evidence of each question (an item is what a source has among sixty neighbouring documents, a story ten neighbours), and what became of the rest."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    rows = fused(spark, sf_dir, 60).withColumn("rank", F.row_number().over(order)).join(docs.select("doc_id", "source"), "doc_id")
    return select_evidence(rows.withColumns({"item_id": F.concat_ws("-", "source", F.floor(F.col("doc_id") / 60).cast("string")), "story": F.floor(F.col("doc_id") / 10), "exempt": F.lit(False)}))


@query()
def h2_dense_topk_lsh(spark, sf_dir):
    """The ten nearest vectors by sketches of signs, and whether the exact search has each; ``test_retrieval`` measures the recall."""
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    ask = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = retrieval.dense_topk(ask, vectors, 10).select("query_id", "vec_id").withColumn("exact", F.lit(True))
    found = retrieval.dense_topk_lsh(ask, vectors, 10)
    return found.join(exact, ["query_id", "vec_id"], "left").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.coalesce("exact", F.lit(False)).alias("exact"))


SAME_QUESTION = 0.97


@query(f"""SELECT query_id, vec_id, similarity FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS r
  FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id < q.vec_id WHERE q.vec_id % 50 = 0) WHERE r = 1 AND similarity >= {SAME_QUESTION - 0.7}""")
def h16_semantic_question_dedup(spark, sf_dir):
    """For each question asked (ids divisible by 50) the most similar earlier one of its fingerprint (label), if it is similar
    enough: 0.97 for questions, 0.27 for the test vectors, of which none are that close."""
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    ask = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    best = retrieval.dense_topk(ask, vectors, 1, group_col="label", earlier=True, least=SAME_QUESTION - 0.7)
    return best.select("query_id", "vec_id", F.col("score").alias("similarity"))


# ---- sweeps and comparisons

# Weights tried for the keyword and the temporal channel.
SPARSE_GRID, TEMPORAL_GRID = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.2), (0.0, 0.05, 0.1, 0.15, 0.25, 0.4)
_MIX = "mix AS (SELECT query_id, 'sparse' AS channel, doc_id, rank FROM sparse UNION ALL SELECT query_id, 'temporal', doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM sparse) WHERE rank <= 10)"
_GRID = f"grid AS (SELECT a, b FROM (SELECT unnest({list(SPARSE_GRID)}) AS a), (SELECT unnest({list(TEMPORAL_GRID)}) AS b))"


@query(f"""WITH {_SPARSE}, {_JUDGED}, {_MIX}, {_GRID}, w AS (SELECT a, b, query_id, doc_id, round(sum(CASE channel WHEN 'sparse' THEN a ELSE b END / (60 + rank)), 9) AS score FROM mix, grid GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, query_id ORDER BY score DESC, doc_id) AS rank FROM w), q AS (SELECT a, b, query_id, count(*) FILTER (WHERE rank <= 10) / count(*) AS r10, count(*) FILTER (WHERE rank <= 40) / count(*) AS r40, coalesce(1 / min(rank), 0) AS rr FROM (SELECT * FROM judged, grid) LEFT JOIN r USING (a, b, query_id, doc_id) GROUP BY ALL)
SELECT CAST(a AS DOUBLE) AS sparse_weight, CAST(b AS DOUBLE) AS temporal_weight, round(avg(r10), 6) AS recall_at_10, round(avg(r40), 6) AS recall_at_40, round(avg(rr), 6) AS mrr FROM q GROUP BY a, b""")
def j7_weight_sweep(spark, sf_dir):
    """Recall and reciprocal rank of every pair of weights over hits found once."""
    hits = channels(spark, sf_dir)
    grid = F.broadcast(spark.createDataFrame([(a, b) for a in SPARSE_GRID for b in TEMPORAL_GRID], "sparse_weight double, temporal_weight double"))  # 42 rows
    by = ["sparse_weight", "temporal_weight"]
    weight = F.when(F.col("channel") == "sparse", F.col("sparse_weight")).otherwise(F.col("temporal_weight"))
    scores = hits.crossJoin(grid).groupBy(*by, "query_id", "doc_id").agg(F.round(F.sum(weight / (60 + F.col("rank"))), 9).alias("score"))
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy(*by, "query_id").orderBy(F.desc("score"), "doc_id")))
    told = judgments(spark, sf_dir).crossJoin(grid).join(ranked, [*by, "query_id", "doc_id"], "left").groupBy(*by, "query_id").agg(
        (F.count_if(F.col("rank") <= 10) / F.count("*")).alias("r10"), (F.count_if(F.col("rank") <= 40) / F.count("*")).alias("r40"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("rr")
    )
    return told.groupBy(*by).agg(F.round(F.avg("r10"), 6).alias("recall_at_10"), F.round(F.avg("r40"), 6).alias("recall_at_40"), F.round(F.avg("rr"), 6).alias("mrr"))


_ALL_TYPES = [*TYPES, "recommendation"]


@query(f"""WITH {_SPARSE}, {_JUDGED}, {_DIMENSIONS}, k AS (SELECT unnest({_ALL_TYPES}) AS kind), v AS (SELECT query_id, kind, doc_id, round(CASE WHEN kind IN ('recent_updates', 'timeline') THEN 0.7e0 * base + 0.3e0 * coalesce(least(1, greatest(0, (epoch(moment) - epoch(TIMESTAMP '{WINDOW[0]}')) / (epoch(TIMESTAMP '{WINDOW[1]}') - epoch(TIMESTAMP '{WINDOW[0]}')))), 0.5e0) ELSE base END, 5) AS final
  FROM (SELECT *, relevance + 0.1e0 * directness + 0.08e0 * {_AFFINITY.format("kind")} AS base FROM dim, k)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY final DESC, doc_id) AS rank FROM v),
m AS (SELECT query_id, kind, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS r10, round(count(*) FILTER (WHERE rank <= 20) / count(*), 6) AS r20 FROM (SELECT query_id, doc_id, kind FROM judged, k) LEFT JOIN r USING (query_id, kind, doc_id) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r10 DESC, r20 DESC, kind) AS place, count(*) OVER (PARTITION BY query_id, r10, r20) AS ties FROM m)
SELECT query_id, CASE WHEN ties = 1 THEN kind END AS best_type, r10 AS recall_at_10, r20 AS recall_at_20 FROM o WHERE place = 1""")
def j8_query_type_sweep(spark, sf_dir):
    """Each question ranked as each of six types would, and the type that finds most, unless two find as much."""
    kinds = F.explode(F.array(*[F.lit(t) for t in _ALL_TYPES])).alias("kind")
    rows = named(spark, sf_dir).select("*", kinds)
    own = W.partitionBy("query_id", "kind")
    low, high = F.min("score").over(own), F.max("score").over(own)
    relevance = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    rows = rows.withColumns({"relevance": relevance, "directness": share(terms(F.col("question")), terms(F.col("title"))), "fit": affinity(F.col("kind"), F.col("tier"))})
    base = F.col("relevance") + 0.1 * F.col("directness") + 0.08 * F.col("fit")
    moment, begin, end = (F.unix_micros(c) / 1e6 for c in (F.col("at"), F.lit(WINDOW[0]).cast("timestamp"), F.lit(WINDOW[1]).cast("timestamp")))
    recency = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (moment - begin) / (end - begin))), F.lit(0.5))
    rows = rows.withColumn("final", F.round(F.when(F.col("kind").isin(FRESH), 0.7 * base + 0.3 * recency).otherwise(base), 5))
    ranked = rows.select("query_id", "kind", "doc_id", F.row_number().over(own.orderBy(F.desc("final"), "doc_id")).alias("rank"))
    told = judgments(spark, sf_dir).select("query_id", "doc_id", kinds).join(ranked, ["query_id", "kind", "doc_id"], "left").groupBy("query_id", "kind").agg(
        *[F.round(F.count_if(F.col("rank") <= k) / F.count("*"), 6).alias(f"recall_at_{k}") for k in (10, 20)]
    )
    places = told.withColumns({"place": F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("recall_at_10"), F.desc("recall_at_20"), "kind")), "ties": F.count("*").over(W.partitionBy("query_id", "recall_at_10", "recall_at_20"))})
    return places.filter("place = 1").select("query_id", F.when(F.col("ties") == 1, F.col("kind")).alias("best_type"), "recall_at_10", "recall_at_20")


_ARM = lambda name, source: f"SELECT '{name}' AS arm, query_id, doc_id, rank FROM {source}"


@query(f"""{_FUSED}, {_JUDGED}, control AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused),
noise AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END, rank) AS rank FROM control),
arm AS ({_ARM("sparse", "sparse")} UNION ALL {_ARM("control", "control")} UNION ALL {_ARM("noise", "noise")}), names AS (SELECT DISTINCT arm FROM arm),
q AS (SELECT arm, query_id, count(*) FILTER (WHERE rank <= 10) / count(*) AS r10, count(*) FILTER (WHERE rank <= 20) / count(*) AS r20 FROM (SELECT * FROM judged, names) LEFT JOIN arm USING (arm, query_id, doc_id) GROUP BY ALL), m AS (SELECT arm, round(avg(r10), 4) AS r10, round(avg(r20), 4) AS r20 FROM q GROUP BY arm)
SELECT m.arm, m.r10 AS recall_at_10, m.r20 AS recall_at_20, round(m.r10 - c.r10, 4) AS delta_10, round(m.r20 - c.r20, 4) AS delta_20 FROM m, m c WHERE c.arm = 'control'""")
def j9_ab_delta(spark, sf_dir):
    """Recall of three arms and what they differ from the control: keywords alone, fused, and with a fifth of the hits put first as noise."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    control = fused(spark, sf_dir).select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
    worse = W.partitionBy("query_id").orderBy(F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1), "rank")
    arms = {"sparse": sparse(spark, sf_dir).select("query_id", "doc_id", "rank"), "control": control, "noise": control.select("query_id", "doc_id", F.row_number().over(worse).alias("rank"))}
    rows = None
    for name, arm in arms.items():
        arm = arm.withColumn("arm", F.lit(name))
        rows = arm if rows is None else rows.unionByName(arm)
    wanted = judgments(spark, sf_dir).select("query_id", "doc_id", F.explode(F.array(*[F.lit(n) for n in arms])).alias("arm"))
    told = wanted.join(rows, ["arm", "query_id", "doc_id"], "left").groupBy("arm", "query_id").agg(*[(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"r{k}") for k in (10, 20)])
    means = told.groupBy("arm").agg(F.round(F.avg("r10"), 4).alias("recall_at_10"), F.round(F.avg("r20"), 4).alias("recall_at_20"))
    base = means.filter("arm = 'control'").select(F.col("recall_at_10").alias("c10"), F.col("recall_at_20").alias("c20"))
    both = means.crossJoin(F.broadcast(base))  # three rows and one
    return both.select("arm", "recall_at_10", "recall_at_20", F.round(F.col("recall_at_10") - F.col("c10"), 4).alias("delta_10"), F.round(F.col("recall_at_20") - F.col("c20"), 4).alias("delta_20"))
