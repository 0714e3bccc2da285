"""Retrieval over the benchmark texts, fusion, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans.registry import query
from corpusloom.sources.tables import read_tables

_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
_SPARSE = f"""term AS (SELECT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
posting AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM posting GROUP BY term), total AS (SELECT count(*) AS n FROM documents),
s AS (SELECT query_id, doc_id, round(sum(ln(n / df)), 6) AS score FROM term JOIN df USING (term) JOIN posting USING (term), total WHERE df <= greatest(1, floor(n * 0.15)) GROUP BY query_id, doc_id),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 40)"""
_DENSE = """unit AS (SELECT vec_id, embedding AS v FROM embeddings), dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
 SELECT q.vec_id AS query_id, u.vec_id, round(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(u.v AS DOUBLE[])), 6) AS score FROM unit q, unit u WHERE q.vec_id % 50 = 0)) WHERE rank <= 60)"""
#: documents that hold a passage are worth 2, the others of their story (five neighbours) 1
_JUDGED = """held AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), judged AS (SELECT query_id, doc_id, max(grade) AS grade FROM (SELECT query_id, doc_id, 2 AS grade FROM held
  UNION ALL SELECT h.query_id, d.doc_id, 1 FROM held h JOIN documents d ON d.doc_id // 5 = h.doc_id // 5) GROUP BY ALL)"""
_FUSED = f"""WITH {_SPARSE}, fresh AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM sparse), mix AS (SELECT query_id, 'sparse' AS channel, doc_id, rank FROM sparse UNION ALL SELECT query_id, 'temporal', doc_id, rank FROM fresh WHERE rank <= 10),
fused AS (SELECT query_id, doc_id, round(sum(CASE channel WHEN 'sparse' THEN 0.6 ELSE 0.15 END / (60 + rank)), 9) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM mix GROUP BY query_id, doc_id)"""


def benchmark_queries(spark, sf_dir):
    (items,) = read_tables(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text")


def sparse(spark, sf_dir, depth: int = 40):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return retrieval.sparse_topk(benchmark_queries(spark, sf_dir), docs, depth)


@query(f"WITH {_SPARSE} SELECT query_id, doc_id, score, rank FROM sparse")
def h3_sparse_topk(spark, sf_dir):
    return sparse(spark, sf_dir).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH posting AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) SELECT term, count(*) AS df FROM posting GROUP BY term")
def d16_document_frequency(spark, sf_dir):
    (docs,) = read_tables(spark, sf_dir, "documents")
    return retrieval.document_frequency(docs, "doc_id", "text")


@query(f"WITH {_DENSE} SELECT query_id, vec_id, rank FROM dense")
def h1_dense_topk(spark, sf_dir):
    (vectors,) = read_tables(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(asked, vectors).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def fused(spark, sf_dir, depth: int = 40):
    keyword = sparse(spark, sf_dir, depth).select("query_id", F.lit("sparse").alias("channel"), "doc_id", "rank")
    newest = W.partitionBy("query_id").orderBy(F.desc("doc_id"))
    fresh = keyword.select("query_id", F.lit("temporal").alias("channel"), "doc_id", F.row_number().over(newest).alias("rank")).filter("rank <= 10")
    return retrieval.reciprocal_ranks(keyword.unionByName(fresh))


@query(f"{_FUSED} SELECT query_id, doc_id, score, channels, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused")
def h5_rrf(spark, sf_dir):
    return fused(spark, sf_dir).select("query_id", "doc_id", "score", "channels", F.col("rank").cast("long").alias("rank"))


@query(f"""{_FUSED}, l AS (SELECT query_id, doc_id, 1 AS c, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM fused UNION ALL SELECT query_id, doc_id, 2, rank FROM fresh),
f AS (SELECT query_id, doc_id, min(r * 2 + c) AS place FROM l GROUP BY query_id, doc_id) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM f""")
def f2_interleave(spark, sf_dir):
    """Two ranked lists dealt in turn; of a document only its first place counts."""
    one = fused(spark, sf_dir).select("query_id", "doc_id", (F.col("rank") * 2 + 1).alias("place"))
    newest = W.partitionBy("query_id").orderBy(F.desc("doc_id"))
    two = sparse(spark, sf_dir).select("query_id", "doc_id", (F.row_number().over(newest) * 2 + 2).alias("place"))
    merged = one.union(two).groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    return merged.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("place")).cast("long").alias("rank"))


def judgments(spark, sf_dir):
    """query_id, doc_id, grade: 2 for a document that holds a question's passage, 1 for the others of its story."""
    docs, items = read_tables(spark, sf_dir, "documents", "benchmark")
    held = retrieval.holders(docs, items.select(F.col("item_id").alias("query_id"), "text"))
    near = held.select("query_id", F.floor(F.col("doc_id") / 5).alias("story")).distinct().join(docs.select("doc_id", F.floor(F.col("doc_id") / 5).alias("story")), "story")
    both = held.withColumn("grade", F.lit(2)).unionByName(near.select("query_id", "doc_id", F.lit(1).alias("grade")))
    return both.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


_METRICS = ", ".join(f"round(count(*) FILTER (WHERE rank <= {k}) / count(*), 6) AS recall_at_{k}" for k in (10, 20, 40)) + ", round(coalesce(1 / min(rank), 0.0), 6) AS mrr, min(rank) AS first_hit, count(*) FILTER (WHERE rank IS NULL) AS missed_items"
_TOLD = f"told AS (SELECT query_id, {_METRICS} FROM judged LEFT JOIN sparse USING (query_id, doc_id) GROUP BY query_id)"


@query(f"WITH {_SPARSE}, {_JUDGED}, {_TOLD} SELECT * FROM told")
def j2_rank_metrics(spark, sf_dir):
    return retrieval.rank_metrics(sparse(spark, sf_dir), judgments(spark, sf_dir))


@query(f"""WITH {_SPARSE}, {_JUDGED}, i AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(p + 1.0)) AS best FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS p FROM judged) WHERE p <= 10 GROUP BY query_id),
g AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1.0)) AS dcg FROM judged JOIN sparse USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id) SELECT query_id, round(coalesce(dcg, 0.0) / best, 6) AS ndcg FROM i LEFT JOIN g USING (query_id)""")
def j3_ndcg(spark, sf_dir):
    return retrieval.ndcg(sparse(spark, sf_dir), judgments(spark, sf_dir))


@query(f"""WITH {_SPARSE}, r AS (SELECT query_id, rank, CASE WHEN doc_id % 10 = 3 THEN 'unknown:' || rank ELSE source END AS source, CAST(substr(source, 4, 10) AS INTEGER) % 4 = 0 AS is_primary FROM sparse JOIN documents USING (doc_id) WHERE rank <= 10),
n AS (SELECT query_id, source, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT query_id, count(*) AS sources, round(max(n) / sum(n), 6) AS dominant FROM n GROUP BY query_id)
SELECT d.*, p.primary_share FROM d JOIN (SELECT query_id, round(avg(CASE WHEN is_primary THEN 1e0 ELSE 0e0 END), 6) AS primary_share FROM r WHERE rank <= 5 GROUP BY query_id) p USING (query_id)""")
def j4_source_diagnostics(spark, sf_dir):
    """Distinct sources of the first ten, the commonest one's share, that of primary ones among the first five.
    A blank source (here: of every tenth document) is one of its own."""
    (docs,) = read_tables(spark, sf_dir, "documents")
    blank = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("unknown:"), F.col("rank").cast("string"))).otherwise(F.col("source"))
    rows = sparse(spark, sf_dir).filter("rank <= 10").join(docs.select("doc_id", "source"), "doc_id")
    rows = rows.select("query_id", "rank", blank.alias("source"), (F.substring("source", 4, 10).cast("int") % 4 == 0).cast("double").alias("leading"))
    counts = rows.groupBy("query_id", "source").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.count("*").alias("sources"), F.round(F.max("n") / F.sum("n"), 6).alias("dominant"))
    return counts.join(rows.filter("rank <= 5").groupBy("query_id").agg(F.round(F.avg("leading"), 6).alias("primary_share")), "query_id")


@query(f"""WITH {_SPARSE}, {_JUDGED}, {_TOLD}, c AS (SELECT 'c' || (query_id % 3) AS category, * FROM told) SELECT category, count(*) AS questions, round(avg(recall_at_10), 5) AS recall_at_10, round(avg(recall_at_20), 5) AS recall_at_20, round(avg(mrr), 5) AS mrr
FROM (SELECT * FROM c UNION ALL SELECT 'overall', * EXCLUDE category FROM c) GROUP BY category""")
def j5_eval_summary(spark, sf_dir):
    """Means over the answerable questions, of all and by category."""
    rows = j2_rank_metrics(spark, sf_dir)
    labels = F.array(F.lit("overall"), F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")))
    rows = rows.select("*", F.explode(labels).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("questions"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall_at_10", "recall_at_20", "mrr")])


@query(f"""WITH {_SPARSE}, hits AS (SELECT query_id, doc_id // 3 AS item_id, rank, score FROM sparse), b AS (SELECT query_id, item_id, min(rank) AS best, max(score) AS score FROM hits GROUP BY ALL)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM b""")
def j1_dedupe_to_items(spark, sf_dir):
    """A ranking of passages (three documents are one item here) as one of items, each at its best place."""
    hits = sparse(spark, sf_dir).select("query_id", F.floor(F.col("doc_id") / 3).alias("item_id"), "rank", "score")
    best = hits.groupBy("query_id", "item_id").agg(F.min("rank").alias("best"), F.max("score").alias("score"))
    return best.select("query_id", "item_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy("best")).cast("long").alias("rank"))
